import os

import pytest
from tomegraph.operators import flatten
from tomegraph.plans import stages
from tomegraph.plans.client import attempt
from tomegraph.plans.ledger import Ledger


class Counting:
    """Notes every prompt in a file; takes the worker down at a text, fails for good at another."""

    def __init__(self, path, deadly=None):
        self.path, self.deadly = str(path), deadly

    def complete(self, prompt, params):
        if self.deadly and self.deadly in prompt:
            os._exit(1)
        with open(self.path, "a") as f:
            f.write(prompt.rpartition("### TEXT\n")[2].strip().replace("\n", " ") + "\n")
        if "refused" in prompt.rpartition("### TEXT\n")[2]:
            raise ValueError("no")
        return f"<entities>\nEntity: {prompt[-3:].strip()}\nType: Item\n</entities>", "length" if "cut" in prompt else "stop"

    def seen(self):
        return open(self.path).read().splitlines() if os.path.exists(self.path) else []


def test_a_killed_run_goes_on(spark, tmp_path):
    rows = [(f"k{i}", f"text {i:02}" + (" refused" if i == 3 else " cut" if i == 4 else "")) for i in range(40)] + [("again", "text 07"), ("none", None)]
    prompts = spark.createDataFrame(rows, "key string, prompt string")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    with pytest.raises(Exception):  # noqa: B017, PT011  the worker is gone
        ledger.call(prompts, Counting(tmp_path / "one", "text 39"), "s", part_calls=4)
    paid = {r.prompt for r in ledger.rows.collect()}
    assert "text 39" not in paid
    second = Counting(tmp_path / "two")
    got = {r.key: (r.status, r.error, r.finish_reason) for r in ledger.call(prompts, second, "s", part_calls=4).collect()}
    assert len(got) == 42 and got["k3"] == ("error", "ValueError: no", None) and got["k4"] == ("ok", None, "length")
    good = {p for p in paid if "refused" not in p}
    assert not good & set(second.seen()) and len(second.seen()) == len(set(second.seen())) == 41 - len(good)
    third = Counting(tmp_path / "three")
    assert ledger.call(prompts, third, "s").count() == 42
    assert third.seen() == ["text 03 refused"]
    assert ledger.call(prompts.limit(0), third, "s").count() == 0


def test_sequential_extraction_goes_on(spark, tmp_path):
    import json

    body = [{"type": "section", "id": f"s{i}", "entries": [f"sec {i:02}"]} for i in range(45)]
    nodes = flatten.flatten(spark.createDataFrame([("d", json.dumps(body)), ("e/x", json.dumps(body[:3]))], "doc_id string, body string"), "indexed")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    with pytest.raises(Exception):  # noqa: B017, PT011
        stages.extract_in_order(nodes, Counting(tmp_path / "one", "sec 30"), ledger=ledger)
    assert ledger.rows.count() == 23  # the first step of 20 sections, and the short document
    second = Counting(tmp_path / "two")
    got = stages.extract_in_order(nodes, second, ledger=ledger)
    assert second.seen() == [f"sec {i:02}" for i in range(20, 45)]
    plain = stages.extract_in_order(nodes, Counting(tmp_path / "three"))
    key = lambda df: sorted((r.doc_id, r.path, [e.label for e in r.entities], r.call.prompt) for r in df.collect())
    assert key(got) == key(plain)
    assert ledger.rows.count() == 48


def test_retries():
    class Late:
        tries = 0

        def complete(self, prompt, params):
            Late.tries += 1
            if Late.tries < 3:
                raise TimeoutError("later")
            return "yes", "stop"

    row = attempt(Late(), "k", "p", "s", retries=1, back_off=0.01)
    assert (row["status"], row["error"]) == ("error", "TimeoutError: later")
    row = attempt(Late(), "k", "p", "s", retries=1, back_off=0.01)
    assert (row["status"], row["response"], row["error"]) == ("ok", "yes", None)


def test_stages_ask_only_once(spark, tmp_path):
    from tomegraph.plans.ledger import Recorded

    sections = spark.createDataFrame([(f"s{i}", f"A section of some length that names the thing {i:02}, and goes on.") for i in range(6)], "key string, content string")
    first = Counting(tmp_path / "one")
    client = Recorded(first, Ledger(spark, str(tmp_path / "ledger")))
    assert stages.recognise(sections, client).count() == 6 and len(first.seen()) == 6
    assert stages.recognise(sections.limit(3), client).count() == 3 and len(first.seen()) == 6
