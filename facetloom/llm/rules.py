"""Quality rules as a short-circuit cascade.

A rule names the measures it reads and when it rejects. On a sample of documents
each rule is timed and its rejections are counted; the cascade then asks the
rules in the order of rejections per second, and a document that one rejects is
asked no more. The order changes the cost and which rule is named first, never
which documents are kept. Measures are taken when first asked for.

Texts are processed whole. A null or empty text has no words: its counts are
zero. Repeated rows get equal verdicts; extra columns are not read.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import arrow_map

SAMPLE_ROWS = 2000
SYMBOLS = b"#*$%&|<>"


class Measures:
    """Counts of one text, each taken at most once."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.data = self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        """Runs of anything but ASCII white space."""
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.data) - len(self.data.translate(None, b" \t\n\v\f\r")))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [line for line in self.data.split(b"\n") if line.strip(b" \t\v\f\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        often = Counter(windows)
        covered, end = 0, 0
        for at, window in enumerate(windows):
            if often[window] > 1:
                covered += at + 3 - max(at, end)
                end = at + 3
        return covered

    @cached_property
    def n_upper(self) -> int:
        """Words of two letters or more without a lower-case one."""
        return sum(1 for w in self.words if len(w) > 1 and w.isupper())

    @cached_property
    def n_marked(self) -> int:
        """Words that end in a doubled mark."""
        return sum(1 for w in self.words if w[-2:] in _DOUBLED)

    @cached_property
    def top_share(self) -> float:
        """Share of the most frequent word longer than four bytes."""
        long = [w for w in self.words if len(w) > 4]
        return max(Counter(long).values()) / len(self.words) if long else 0.0


_DOUBLED = {bytes([c, c]) for c in b"!?#*$%&~"}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


#: Rules beside the base checks; shares are of words unless said otherwise.
RULES = (
    Rule("symbols", lambda m: 10 * m.n_symbols > 3 * m.n_words),
    Rule("repeated_lines", lambda m: len(m.lines) >= 4 and 10 * m.n_dup_lines > 4 * len(m.lines)),
    Rule("shouting", lambda m: m.n_words >= 20 and 2 * m.n_upper > m.n_words),
    Rule("marks", lambda m: 4 * m.n_marked > m.n_words),
    Rule("word_length", lambda m: m.n_words > 0 and not 2 * m.n_words <= m.word_chars <= 20 * m.n_words),
    Rule("one_word", lambda m: m.n_words >= 50 and m.top_share > 0.25),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def hash_sample(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` documents, the same whenever the rows are the same."""
    share = min(1.0, rows / max(1, docs.count()))
    steps = 1 << 30
    return docs.where(F.pmod(F.xxhash64(F.lit("rule sample"), "doc_id", "text"), F.lit(steps)) < int(share * steps))


def rule_order(docs: DataFrame, rules=RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds per document, share rejected) in the order to ask them.

    Documents of the sample are measured where they lie; only sums come back.
    """
    kinds = pa.schema([("rule", pa.int32()), ("seconds", pa.float64()), ("rejected", pa.int64()), ("n", pa.int64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                n += 1
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[k] += rule.rejects(Measures(text))
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(rules)), pa.int32()), pa.array(spent), pa.array(rejected, pa.int64()), pa.array([n] * len(rules), pa.int64())],
            schema=kinds,
        )

    sums = hash_sample(docs, rows).transform(arrow_map, measure, "rule int, seconds double, rejected long, n long")
    found = sums.groupBy("rule").agg(F.sum("seconds"), F.sum("rejected"), F.sum("n")).collect()
    measured = [(rules[k].name, s / max(1, n), r / max(1, n)) for k, s, r, n in found]
    return sorted(measured, key=lambda r: (-r[2] / max(r[1], 1e-9), r[0]))


def cascade(docs: DataFrame, rules=RULES, report: tuple[str, ...] = BASE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, measures in ``report``, first_rejection, n_asked) per row of ``docs`` (doc_id, text).

    ``first_rejection`` is null for documents that every rule lets pass.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [name for name, _, _ in rule_order(rows, rules, sample_rows)]
    ordered = sorted(rules, key=lambda r: names.index(r.name) if r.name in names else len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                first, asked, kept = [], [], [[] for _ in report]
                for text in batch.column(1).to_pylist():
                    m = Measures(text)
                    for k, rule in enumerate(ordered):
                        if rule.rejects(m):
                            first.append(rule.name)
                            asked.append(k + 1)
                            break
                    else:
                        first.append(None)
                        asked.append(len(ordered))
                    for values, name in zip(kept, report, strict=True):
                        values.append(getattr(m, name))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(v, pa.int64()) for v in kept), pa.array(first, pa.string()), pa.array(asked, pa.int64())],
                    ["doc_id", *report, "first_rejection", "n_asked"],
                )

    counts = "".join(f"{name} long, " for name in report)
    return rows.transform(arrow_map, run, f"doc_id long, {counts}first_rejection string, n_asked long")
