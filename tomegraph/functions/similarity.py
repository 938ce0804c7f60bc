"""Label similarity: edit distance, the label rule, a weighted fuzzy score, cosine (FN-9, FN-10, GRA-8)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - distance / longer length); 100 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / longest))


def similar_labels(a: Column, b: Column) -> Column:
    """Equal, contained with half the length at least, two edits, or a fifth of the length in edits."""
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    inside = (F.contains(a, b) | F.contains(b, a)) & (shortest >= 0.5 * longest)
    distance = F.levenshtein(a, b)
    blank = F.coalesce((a == "") | (b == ""), F.lit(True))
    return F.when(blank, False).otherwise((a == b) | inside | (distance <= 2) | (distance <= 0.2 * longest))


def cosine(a: Column, b: Column) -> Column:
    """Of two float arrays in double precision; 0 where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence; each letter of b moves a set of columns held in one number."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        met = free & place.get(c, 0)
        free = (free + met | free - met) & full
    return len(a) - free.bit_count()


def _ratio(a: str, b: str) -> float:
    """100 less the share of letters that must be put in or left out to get from one to the other."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def _partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with any run of the longer one, at its ends also shorter runs."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(short), len(long)
    if not n:
        return 0.0 if m else 100.0
    runs = [long[max(0, i) : min(m, i + n)] for i in range(1 - n, m)]
    return max(_ratio(short, x) for x in runs)


def _tokens(a: str, b: str, score) -> float:
    """The better of the scores of sorted tokens and of token sets."""
    x, y = a.split(), b.split()
    best = score(" ".join(sorted(x)), " ".join(sorted(y)))
    both, left, right = (" ".join(sorted(t)) for t in (set(x) & set(y), set(x) - set(y), set(y) - set(x)))
    if both and (score is _partial or not left or not right):
        return 100.0
    if score is _partial:
        return max(best, score(left, right))
    join = lambda t: f"{both} {t}" if both and t else both or t
    best = max(best, score(join(left), join(right)))
    return max(best, score(both, join(left)), score(both, join(right))) if both else best


def weighted_ratio(a: str, b: str) -> float:
    """The weighted score that fuzzy matchers are known for: the plain ratio, tokens at 0.95, and from 1.5 times the length on partial scores at 0.9, or 0.6 beyond 8 times."""
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    best = _ratio(a, b)
    if spread < 1.5:
        return max(best, 0.95 * _tokens(a, b, _ratio))
    scale = 0.9 if spread <= 8 else 0.6
    return max(best, scale * _partial(a, b), 0.95 * scale * _tokens(a, b, _partial))


#: Classes that letters are counted in; letters of one class only raise a bound.
LETTER_CLASSES = 64


class Counted:
    """Texts with their letters counted, as they are, with tokens sorted and with token sets: what weighted_ratio compares."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        tokens = [t.split() for t in texts]
        forms = (texts, [" ".join(sorted(t)) for t in tokens], [" ".join(sorted(set(t))) for t in tokens])
        self.length = [np.array([len(t) for t in form], np.int64) for form in forms]
        self.letters = [self._letters(form) for form in forms]
        self.holding: dict[str, list[int]] = {}
        for i, t in enumerate(tokens):
            for w in set(t):
                self.holding.setdefault(w, []).append(i)

    @staticmethod
    def _letters(form: list[str]) -> np.ndarray:
        out = np.zeros((len(form), LETTER_CLASSES), np.int32)
        size = np.array([len(t) for t in form], np.int64)
        codes = np.frombuffer("".join(form).encode("utf-32-le", "surrogatepass"), "<u4") % LETTER_CLASSES
        np.add.at(out, (np.repeat(np.arange(len(form)), size), codes), 1)
        return out

    def bounds(self, other: Counted, j: int) -> np.ndarray:
        """For each text at least its weighted_ratio with other's j-th one.

        A common subsequence is no longer than what two texts have in common letter by letter, and no run of the longer
        text fits the shorter one better than a run of just these letters. Texts that share a token may reach 100.
        """
        whole, part = [], []
        for length, letters, n, own in zip(self.length, self.letters, other.length, other.letters, strict=True):
            common = np.minimum(letters, own[j]).sum(axis=1)
            least = np.minimum(length, n[j])
            whole.append(200.0 * common / np.maximum(length + n[j], 1))
            part.append(200.0 * common / np.maximum(least + common, 1))
        shorter, longer = np.minimum(self.length[0], other.length[0][j]), np.maximum(self.length[0], other.length[0][j])
        spread = longer / np.maximum(shorter, 1)
        scale = np.where(spread <= 8, 0.9, 0.6)
        near = np.maximum(whole[0], 0.95 * np.maximum(whole[1], whole[2]))
        far = np.maximum(whole[0], scale * np.maximum(part[0], 0.95 * np.maximum(part[1], part[2])))
        out = np.where(spread < 1.5, near, far) + 1e-9
        out[(self.length[1] == 0) | (other.length[1][j] == 0)] = 100.0  # blanks alone
        for w in set(other.texts[j].split()):
            out[self.holding.get(w, [])] = 100.0
        return out


def best_partners(labels: Counted, names: Counted, threshold: float, best: dict[str, tuple[float, str]]) -> int:
    """Put each label's best name, (-score, name), into best if it beats the one there; how many pairs were scored.

    Names come by falling bound, and those that can't reach the best score so far are never scored.
    """
    scored = 0
    for j, q in enumerate(labels.texts):
        bound = names.bounds(labels, j)
        bar = max(threshold, -best[q][0]) if q in best else threshold
        able = np.flatnonzero(bound >= bar)
        for i in able[np.argsort(-bound[able], kind="stable")].tolist():
            if q in best and bound[i] < -best[q][0]:
                break
            scored += 1
            n = names.texts[i]
            s = weighted_ratio(q, n)
            if s >= threshold and (q not in best or (-s, n) < best[q]):
                best[q] = (-s, n)
    return scored


def weighted_score(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([weighted_ratio(p or "", q or "") for p, q in zip(x, y, strict=True)])

    return run(a, b)
