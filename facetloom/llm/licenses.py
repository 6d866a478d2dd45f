"""License scan by conditional compression.

Lines and sentences with a licence cue, and runs of such close to one another,
are candidate blocks. A notice may be wrapped at any width and stand in comments:
beside lines, sentences are taken over line ends, with comment marks as spaces,
from the longest template's words before a cue to as many after it. Each block is compressed alone and with every template as
a raw Zstandard dictionary; the template that saves the largest share is the
winner. A winner counts only if its exact wording holds: the words it has more
or fewer than the block, between the first and the last word they share, must
stay within ``TOLERANCE`` of its length, and its numbers must all be there.

Whole texts are scanned, lines of any length. Null and empty texts have no
blocks; repeated blocks are judged once per worker and reported each time; of
equal savings the first template by name wins. Repeated rows report twice. Of
two blocks one of which lies inside the words of a confirmed other, the outer is
reported; notices that stand next to each other are reported each.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import arrow_map
from facetloom.llm.tokens import Memory

TOLERANCE = 0.1
NEAR = 2  # sentences between two cues of one run
BLOCKS_KEPT = 20_000

#: Wordings of well-known licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
        " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: What a sentence of a notice has in it.
CUE = r"(?i)licen[sc]e|redistribut|permission[\W_]+is[\W_]+hereby|public[\W_]+domain|creative[\W_]+commons|copyright"

SENTENCE = re.compile(r"[^\n]+?(?:[.!?;](?=\s)|(?=\n)|$)", re.S)
WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W\d_]+")


#: Ends of lines inside a paragraph, with the comment marks of the next line.
LINE_END = re.compile(r"\n[^\S\n]*(?:(?:[#*;%>]|//|--)+[^\S\n]*)?(?=\S)")


def runs(text: str, places: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """Places of ``text`` with a cue, and first and last of runs of them."""
    cue = re.compile(CUE)
    hits = [k for k, (s, e) in enumerate(places) if cue.search(text, s, e)]
    found, run = [], []
    for k in [*hits, None]:
        if run and (k is None or k - run[-1] > NEAR + 1):
            if len(run) > 1:
                found.append((run[0], run[-1]))
            run = []
        run.append(k)
    return hits, found


def blocks(text: str, reach: int) -> list[list[tuple[int, int, bool]]]:
    """Candidates by (start, end, over line ends): each with longer versions.

    A notice may go on after its last cue, so a version reaches up to ``NEAR``
    sentences further. Over line ends it has at most ``reach`` words on each side of a cue.
    """
    places = [m.span() for m in SENTENCE.finditer(text)]
    hits, several = runs(text, places)
    last = len(places) - 1
    out = [[(places[a][0], places[k][1], False) for k in range(b, min(b + NEAR, last) + 1)] for a, b in [(k, k) for k in hits] + several]
    flat = LINE_END.sub(lambda m: " " * len(m[0]), text)
    if flat == text:
        return out
    wide = [m.span() for m in SENTENCE.finditer(flat)]
    starts = [s for s, _ in wide]
    words = [m.span() for m in WORD.finditer(flat)]
    firsts = [s for s, _ in words]
    cue = re.compile(CUE)
    group = {k: (a, b) for a, b in runs(flat, wide)[1] for k in range(a, b + 1)}
    cues = [(cue.search(text, *versions[0][:2]).start(), versions) for versions in out[: len(hits)]]
    # Cues that are wrapped themselves.
    cues += [(m.start(), []) for m in cue.finditer(flat) if "\n" in text[m.start() : m.end()] and "\n" not in m[0]]
    out += [versions for _, versions in cues[len(hits) :]]
    for at, versions in cues:
        own = bisect_right(starts, at) - 1
        middle = bisect_left(firsts, at)
        low = firsts[max(0, middle - reach)] if words else 0
        high = words[min(len(words) - 1, middle + reach)][1] if words else len(flat)
        ends = [(own, k) for k in range(own, min(own + NEAR, len(wide) - 1) + 1)]
        for a, b in [*ends, *([group[own]] if own in group else [])]:
            one = (max(low, wide[a][0]), min(high, wide[b][1]) if high > at else wide[b][1], True)
            if one not in versions:
                versions.append(one)
    return out


def differences(block: list[str], template: list[str]) -> tuple[list[str], list[str], tuple[int, int]]:
    """Words missing from the block, and those it has beside, within the shared stretch, and this stretch."""
    same = [m for m in SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return template, [], (0, 0)
    missing, extra = list(template[: same[0].b]), []
    for a, b in zip(same, same[1:], strict=False):
        extra += block[a.a + a.size : b.a]
        missing += template[a.b + a.size : b.b]
    stretch = same[0].a, same[-1].a + same[-1].size
    return missing + template[same[-1].b + same[-1].size :], extra, stretch


class Scanner:
    def __init__(self, templates: dict[str, str], tolerance: float) -> None:
        import zstandard as z

        self.tolerance = tolerance
        frame = z.ZstdCompressionParameters.from_level(
            9, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS
        )
        self.alone = z.ZstdCompressor(compression_params=frame)
        self.words = {name: WORD.findall(text.lower()) for name, text in sorted(templates.items())}
        self.given = {
            name: z.ZstdCompressor(
                compression_params=frame,
                dict_data=z.ZstdCompressionDict(text.encode(), dict_type=z.DICT_TYPE_RAWCONTENT),
            )
            for name, text in sorted(templates.items())
        }
        self.reach = int(max(map(len, self.words.values())) * (1 + tolerance)) + 1
        self.known = Memory(self.judge, BLOCKS_KEPT)

    def judge(self, block: str) -> dict:
        data = " ".join(block.split()).encode()
        plain = len(self.alone.compress(data))
        saved = {name: 1 - len(c.compress(data)) / plain for name, c in self.given.items()}
        ranked = sorted(saved, key=lambda n: (-saved[n], n))
        winner, places = ranked[0], list(WORD.finditer(block))
        wording = self.words[winner]
        missing, extra, (first, after) = differences([m[0].lower() for m in places], wording)
        numbers = not any(w[0].isdigit() for w in missing)
        return {
            "license": winner, "reduction": saved[winner], "runner_up": ranked[1] if len(ranked) > 1 else None,
            "missing": " ".join(missing), "extra": " ".join(extra),
            "confirmed": numbers and len(missing) + len(extra) <= self.tolerance * len(wording),
            "span": (places[first].start(), places[after - 1].end()) if after else (0, 0),
        }

    def first(self, text: str, flat: str, versions: list[tuple[int, int, bool]]) -> tuple[int, int, dict]:
        """The shortest version that is confirmed, or else the shortest."""
        shortest = None
        for s, e, over in versions:
            judged = (s, e, self.known[(flat if over else text)[s:e]])
            if judged[2]["confirmed"]:
                return judged
            shortest = shortest or judged
        return shortest

    def scan(self, text: str) -> list[dict]:
        """Judged blocks of one text, each once, without those inside the words of a confirmed one."""
        flat = LINE_END.sub(lambda m: " " * len(m[0]), text)
        judged = {}
        for versions in blocks(text, self.reach):
            s, e, j = self.first(text, flat, versions)
            judged[s, e] = j
        # Words of confirmed blocks, from first to last shared one, outer before inner.
        whole = sorted((s + j["span"][0], -s - j["span"][1], s, -e) for (s, e), j in judged.items() if j["confirmed"])
        ends = list(accumulate((-w[1] for w in whole), max))
        inner = {(w[2], -w[3]) for w, before in zip(whole[1:], ends, strict=False) if -w[1] <= before}
        for (s, e), j in judged.items():
            if not j["confirmed"]:
                block = text[s:e]
                low, high = e - len(block.lstrip()), s + len(block.rstrip(" \t\n.;"))
                k = bisect_right(whole, (low, 1)) - 1
                if k >= 0 and ends[k] >= high:
                    inner.add((s, e))
        return [
            {"start": s, "end": e} | {k: v for k, v in j.items() if k != "span"}
            for (s, e), j in judged.items() if (s, e) not in inner
        ]


FOUND = (
    "doc_id long, start long, end long, license string, reduction double, runner_up string,"
    " missing string, extra string, confirmed boolean"
)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Judged blocks of ``docs`` (doc_id, text): characters from ``start`` to ``end``.

    A block inside the words of a confirmed one is not reported again.
    """
    templates = templates or TEMPLATES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, tolerance)
        schema = pa.schema([
            ("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()),
            ("reduction", pa.float64()), ("runner_up", pa.string()), ("missing", pa.string()), ("extra", pa.string()),
            ("confirmed", pa.bool_()),
        ])
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [{"doc_id": doc, **found} for found in scanner.scan(text)]
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.where(F.col("text").rlike(CUE)).transform(arrow_map, run, FOUND)
