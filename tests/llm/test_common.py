from tests.llm.fixtures import documents, odd_rows
from tomegraph.llm.common import identified, materialise


def test_numbers_of_several_files_need_no_python(spark):
    """The files' numbers are a table of the JVM's own; a list of rows would start Python workers for it."""
    docs = materialise(documents(spark, odd_rows()).repartition(3), "three-files")
    known = identified(docs)
    assert "ExistingRDD" not in known._jdf.queryExecution().toString()
    assert known.select("row").distinct().count() == len(odd_rows())
