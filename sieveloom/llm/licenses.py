"""License scans: ordered signature rules with a keyword prefilter and suppression of overlapping detections.

Texts without any rule's keyword are passed over by one scan of the Arrow
column. In the others an Aho-Corasick automaton finds which keywords there are,
and only the regexes behind these are searched, over the whole text.

Detections are ranked by priority, then length (longer first), start and rule
order. In that order, a detection is suppressed if its interval lies within the
interval of one that stays, or overlaps one of higher priority; equal intervals
of one priority thus go to the earlier rule. What stays is the result, a row each.

A tag's expression (``Apache-2.0 OR MIT``, with brackets or without) gives a
detection for each operand that the rules know. Offsets count characters. Null and empty texts have no detections; a text of any
length is searched whole. Rows without ``doc_id`` are left out; repeated rows
are scanned each. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm.common import documents, table
from sieveloom.llm.license_rules import Rule, rules

SCHEMA = "doc_id bigint, licence string, rule string, priority int, start int, end int, matched string"


def resolve(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The detections (priority, start, end, rule) that stay, by start."""
    stay: list[tuple[int, int, int, int]] = []
    for d in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
        if not any(s[1] <= d[1] and d[2] <= s[2] or s[0] > d[0] and s[1] < d[2] and d[1] < s[2] for s in _near(stay, d)):
            stay.append(d)
    return sorted(stay, key=lambda d: (d[1], d[2], d[3]))


def _near(stay: list, d: tuple) -> list:
    return stay if len(stay) < 64 else [s for s in stay if s[1] < d[2] and d[1] < s[2]]


class Scanner:
    def __init__(self, of: list[Rule] | None = None):
        import ahocorasick

        self.rules = rules() if of is None else of
        by: dict[str, list[int]] = {}
        for k, r in enumerate(self.rules):
            by.setdefault(r.keyword, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for word, k in by.items():
            self.automaton.add_word(word, k)
        self.automaton.make_automaton()
        # a keyword that holds another needs no mention of its own
        stems = [w for w in by if not any(v != w and v in w for v in by)]
        self.any_keyword = "(?i)" + "|".join(re.escape(w) for w in sorted(stems))

    def scan(self, text: str) -> list[tuple[int, int, int, int]]:
        on = sorted({k for _, ks in self.automaton.iter(text.lower()) for k in ks})
        return resolve([(self.rules[k].priority, *m.span(self.rules[k].group), k) for k in on for m in self.rules[k].regex.finditer(text)])


def detections(docs: DataFrame) -> DataFrame:
    """(doc_id, licence, rule, priority, start, end, matched), one row for each detection that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            hit = np.flatnonzero(pc.match_substring_regex(b.column(1), scanner.any_keyword).fill_null(False).to_numpy(zero_copy_only=False))
            ids, out = b.column(0), []
            for i in hit.tolist():
                text = b.column(1)[i].as_py()
                out += [(i, scanner.rules[k].licence, scanner.rules[k].name, p, s, e, text[s:e]) for p, s, e, k in scanner.scan(text)]
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            rest = [pa.array(c, t) for c, t in zip(columns[1:], kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *rest], ["doc_id", "licence", "rule", "priority", "start", "end", "matched"])

    return documents(docs.select(F.col("doc_id").cast("bigint"), "text"), "text").mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return detections(table(spark, sf_dir, "documents"))
