"""Operator 1: quality rules as a short-circuit cascade.

A rule is a predicate over features of one whole text.  Features are steps that run when a rule first
asks for them and at most once a document: some are cheap (counts of bytes), some costly (words, repeated
windows).  A bounded sample of documents gives the seconds of every step and rule, and which rules reject
which documents together.  The cascade takes the rule of the most rejections per second next, where
rejections are those among documents that the rules before it kept, and seconds include the
steps that no rule before it has run.  A document leaves at the first rule that rejects it, and later
steps never run for it.  The rules are a conjunction, so the verdict does not depend on the
order that was measured; only the work does.

Defined cases: a null text is an empty one (no words: it fails the base rule); ids may
be null or repeat, each row gets its own result; an empty table gives an empty result;
extra columns are ignored by ``quality_scores`` and kept by ``quality_filter``.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import spread, text_bytes

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_STARTS = bytes(range(0x80, 0xC0)) + _SPACE  # what is left after deleting these: one byte a code point
_ASCII_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_MARKS = bytes(range(0x21, 0x41))  # ASCII marks and digits
WINDOW = 5

BASE_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_window_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words that lie in a k-word window found twice or more in the text."""
    n = len(words)
    if n <= k:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    if v == n:
        return 0
    if float(v) ** k < 2.0**62:
        key = ids[: n - k + 1].copy()
        for j in range(1, k):
            key = key * v + ids[j : n - k + 1 + j]
    else:  # too many words for one exact 64-bit key: renumber the windows as they grow
        key = ids
        for j in range(1, k):
            key = np.unique(key[: n - j] * v + ids[j:], return_inverse=True)[1]
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = times[which] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[:-1] += np.bincount(at, minlength=n)
    edge -= np.bincount(at + k, minlength=n + 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


#: The steps a rule can ask for, each from the text (``f.text``) and other steps.
STEPS: dict[str, Callable[[Features], object]] = {
    "words": lambda f: f.text.split(),
    "n_words": lambda f: len(f["words"]),
    "word_chars": lambda f: len(f.text.translate(None, _NOT_STARTS)),
    "n_symbols": lambda f: len(f.text) - len(f.text.translate(None, SYMBOLS)),
    "n_dup_lines": lambda f: _repeated([x for x in f.text.split(b"\n") if x.strip()]),
    "n_repeat_words": lambda f: repeated_window_words(f["words"]),
}
#: What a step asks for itself.
DEPENDS = {"n_words": ("words",), "n_repeat_words": ("words",)}


class Features(dict):
    """A text's features, made when first asked for."""

    def __init__(self, text: bytes):
        super().__init__()
        self.text = text

    def __missing__(self, name: str):
        value = self[name] = STEPS[name](self)
        return value


def _repeated(items: list[bytes]) -> int:
    return len(items) - len(set(items))


def base_features(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    f = Features(text)
    return tuple(f[x] for x in BASE_FIELDS)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


@dataclass(frozen=True)
class Rule:
    """``rejects(features)`` is true when the document is to go; needs: the steps it may ask for."""

    name: str
    rejects: Callable[[Features], bool]
    needs: tuple[str, ...] = ()


def _few_words(f: Features) -> bool:
    return f["n_words"] < 10


def _repeats(f: Features) -> bool:
    return 100 * f["n_repeat_words"] > 20 * f["n_words"]


def _symbol_share(f: Features) -> bool:
    return 100 * f["n_symbols"] > 10 * f["n_words"]


def _dup_lines(f: Features) -> bool:
    return f["n_dup_lines"] >= 3 and 100 * f["n_dup_lines"] > 30 * (f.text.count(b"\n") + 1)


def _mean_word(f: Features) -> bool:
    return not 2 * f["n_words"] <= f["word_chars"] <= 15 * f["n_words"]


def _upper_share(f: Features) -> bool:
    letters = len(f.text) - len(f.text.translate(None, _ASCII_LETTERS))
    upper = len(f.text) - len(f.text.translate(None, _UPPER))
    return letters >= 20 and 10 * upper > 7 * letters


def _marks(f: Features) -> bool:
    return 10 * f.text.count(b"!!") > 3 * f["n_words"]


def _top_word(f: Features) -> bool:
    words = f["words"]
    return len(words) >= 10 and 10 * Counter(words).most_common(1)[0][1] > 4 * len(words)


def _no_letters(f: Features) -> bool:
    words = f["words"]
    return 2 * sum(w.isdigit() or not w.translate(None, _MARKS) for w in words) > len(words)


#: The two halves of ``base_failed``.
BASE_RULES = (Rule("few_words", _few_words, ("n_words",)), Rule("repeats", _repeats, ("n_words", "n_repeat_words")))

#: The production rules, in no order: the cascade finds one.
RULES = (
    Rule("symbol_share", _symbol_share, ("n_words", "n_symbols")),
    Rule("dup_lines", _dup_lines, ("n_dup_lines",)),
    Rule("mean_word", _mean_word, ("n_words", "word_chars")),
    Rule("upper_share", _upper_share),
    Rule("marks", _marks, ("n_words",)),
    Rule("top_word", _top_word, ("words",)),
    Rule("no_letters", _no_letters, ("words",)),
)


def all_steps(names: Iterable[str]) -> set[str]:
    """The named steps and those they ask for."""
    out = set(names)
    for name in names:
        out |= all_steps(DEPENDS.get(name, ()))
    return out


@dataclass(frozen=True)
class Costs:
    """seconds: of a step or rule, a document; gone: documents of the sample by the set of rules that reject them."""

    seconds: dict[str, float]
    gone: dict[frozenset[str], int]


def _timed(make: Callable[[], object], name: str, spent: dict[str, float]) -> object:
    start = time.perf_counter()
    value = make()
    spent[name] = spent.get(name, 0.0) + time.perf_counter() - start
    return value


def measured(texts: list[bytes], rules: tuple[Rule, ...]) -> tuple[dict[str, float], Counter]:
    """Seconds in all by step and rule, each with what it asks for ready; texts by the rules that reject them."""
    spent: dict[str, float] = {}
    gone: Counter = Counter()
    steps = [x for x in STEPS if x in all_steps([n for r in rules for n in r.needs])]  # STEPS names a step after those it needs
    for text in texts:
        f = Features(text)
        for x in steps:
            _timed(lambda: f[x], x, spent)  # noqa: B023
        gone[frozenset(r.name for r in rules if _timed(lambda: r.rejects(f), r.name, spent))] += 1  # noqa: B023
    return spent, gone


def rule_costs(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> Costs:
    """Costs measured on a sample of about ``sample_rows`` documents, evenly drawn by a fixed seed.  A row for each
    step, rule and set of rules that occurs reaches the driver (2 ** rules at most, and no more than documents)."""
    n = docs.count()
    if not n:
        return Costs({}, {})
    part = docs.select(text_bytes().alias("t")).sample(fraction=min(1.0, sample_rows / n), seed=7)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spent, gone = measured([x or b"" for x in b.column(0).to_pylist()], rules)
            out = [{"names": [x], "sec": s, "n": 0} for x, s in spent.items()] + [{"names": sorted(x), "sec": None, "n": k} for x, k in gone.items()]
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("names", pa.list_(pa.string())), ("sec", pa.float64()), ("n", pa.int64())]))

    rows = part.mapInArrow(measure, "names array<string>, sec double, n long")
    got = rows.groupBy("names", F.col("sec").isNull().alias("whole")).agg(F.sum("sec").alias("sec"), F.sum("n").alias("n")).collect()
    gone = {frozenset(r["names"]): r["n"] for r in got if r["whole"]}
    taken = max(1, sum(gone.values()))
    return Costs({r["names"][0]: r["sec"] / taken for r in got if not r["whole"]}, gone)


def cascade_order(rules: Iterable[Rule], costs: Costs, ready: Iterable[str] = ()) -> list[Rule]:
    """Most rejections per second next, among what is left and with the steps not yet run (``ready``: run
    before all rules); of equals the cheaper one, then by name."""
    left, alive, done, order = list(rules), dict(costs.gone), all_steps(ready), []
    while left:

        def worth(r: Rule) -> tuple[float, float, str]:
            sec = sum(costs.seconds.get(x, 0.0) for x in [r.name, *(all_steps(r.needs) - done)])  # noqa: B023
            return -sum(k for names, k in alive.items() if r.name in names) / max(sec, 1e-9), sec, r.name  # noqa: B023

        best = min(left, key=worth)
        order.append(best)
        left.remove(best)
        done |= all_steps(best.needs)
        alive = {names: k for names, k in alive.items() if best.name not in names}
    return order


def passes(f: Features, order: list[Rule]) -> bool:
    """True when no rule rejects the text; rules and steps after the first rejection do not run."""
    return not any(r.rejects(f) for r in order)


def quality_scores(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """doc_id, the base features, base_failed and kept for every row of docs(doc_id, text).  The base features are
    results here, so they run for every document and are free to the rules."""
    order = cascade_order(rules, rule_costs(docs, rules, sample_rows), ready=BASE_FIELDS)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, failed, kept = [], [], []
            for x in b.column(1).to_pylist():
                f = Features(x or b"")
                base.append([f[name] for name in BASE_FIELDS])
                failed.append(base_failed(f["n_words"], f["n_repeat_words"]))
                kept.append(not failed[-1] and passes(f, order))
            cols = list(zip(*base)) if base else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(list(c), pa.int64()) for c in cols), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                names=["doc_id", *BASE_FIELDS, "base_failed", "kept"],
            )

    rows = spread(docs.select("doc_id", text_bytes().alias("text")), "doc_id")
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{x} long" for x in BASE_FIELDS) + ", base_failed boolean, kept boolean"
    return rows.mapInArrow(judge, schema)


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor ``rules`` reject, all columns unchanged; the base rules
    stand in the same cascade.  Each row is judged where it is: nothing is joined back, so repeated and null ids are
    no special case."""
    rules = BASE_RULES + tuple(rules)
    order = cascade_order(rules, rule_costs(docs, rules, sample_rows))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [passes(Features(x or b""), order) for x in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
