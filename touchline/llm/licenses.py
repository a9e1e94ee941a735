"""License scans: one Aho-Corasick automaton finds identifier tags and notice phrases in the normalised words of a text;
the expression after a tag is read by a shunting-yard parser for and, or and with.

Normalised: A-Z lower-cased, words joined by single spaces. A tag's expression also needs brackets, dots and signs, so it
is read from the raw text behind the tag.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import slices

# The contract's phrases and labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notice phrases (public licence texts) and their labels.
NOTICE_PHRASES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
# Identifier tags; an expression follows.
TAGS = ("spdx license identifier", "license expression")
_TAG = r"(?:spdx-license-identifier|license-expression)\s*:"
#: What stands behind a tag, up to the next tag or the end of the line.
TAG_TEXT = re.compile(rf"{_TAG}\s*((?:(?!{_TAG})[^\r\n])*)".encode(), re.I)
TOKEN = re.compile(rb"\(|\)|[A-Za-z0-9.+-]+")
#: Binding strength: with over and over or.
STRENGTH = {"or": 1, "and": 2, "with": 3}
# Families of licence identifiers (public SPDX list, and bsd); a version, only, or later or + may follow.
FAMILIES = (
    "0bsd afl agpl apache apsl artistic blueoak bsd bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear "
    "bsd-4-clause bsl busl bzip2 cc-by cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd cc-by-sa cc0 cddl cecill cpl curl ecl epl eupl "
    "fsfap gfdl gpl hpnd icu ijg ipl isc json lgpl libpng lppl mit mit-0 mpl ms-pl ms-rl mulanpsl ncsa odbl ofl openssl osl pddl php "
    "postgresql psf python qpl ruby sleepycat sspl tcl unicode-dfs unlicense upl vim w3c wtfpl x11 zlib zpl"
).split()
# Families that ask for no more than notices.
PERMISSIVE = "0bsd apache blueoak bsd bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsl cc-by cc0 curl isc libpng mit mit-0 ncsa postgresql psf python unlicense upl x11 zlib".split()
_VERSION = r"(?:-\d+(?:\.\d+)*)?(?:-only|-or-later|\+)?"
LICENCE = re.compile(f"(?:{'|'.join(map(re.escape, FAMILIES))}){_VERSION}|licenseref-[a-z0-9.-]+")
PERMISSIVE_LICENCE = re.compile(f"(?:{'|'.join(map(re.escape, PERMISSIVE))}){_VERSION}")
EXCEPTION = re.compile(r"[a-z0-9.+-]*exception(?:-\d+(?:\.\d+)*)?|linux-syscall-note")
# Weight of evidence; the score is 1 - product of (1 - weight).
WEIGHTS = {"tag": 0.9, "base": 0.6, "notice": 0.4}

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = "doc_id bigint, n_words bigint, hits array<struct<kind:string,word:bigint,label:string>>, expressions array<struct<text:string,valid:boolean,licences:array<string>,permissive:boolean>>"


def parse_expression(text: str) -> list | None:
    """Shunting-yard: reverse Polish output of the longest valid expression at the start of text, None where none starts.

    Operators may be in either case. An operand is a licence identifier (see LICENCE), behind with an exception (see
    EXCEPTION); with binds to the identifier right before it. Any other word ends the expression. Linear in the text.
    """
    output: list = []
    stack: list[str] = []
    length, tail, depth, last = 0, None, 0, ""
    for token in (m.group().decode("latin-1").rstrip(".") for m in TOKEN.finditer(text.encode())):
        low = token.lower()
        if last in ("", "(", *STRENGTH):  # an operand is next
            if token == "(" and last != "with":
                stack.append(token)
                depth += 1
                last = token
                continue
            if not (EXCEPTION if last == "with" else LICENCE).fullmatch(low):
                break
            output.append(low)
            last = "exception" if last == "with" else "licence"
        elif token == ")":
            if not depth:
                break
            while stack[-1] != "(":
                output.append((stack.pop(),))
            stack.pop()
            depth -= 1
            last = token
        elif low in STRENGTH and (low != "with" or last == "licence"):
            while stack and stack[-1] != "(" and STRENGTH[stack[-1]] >= STRENGTH[low]:
                output.append((stack.pop(),))
            stack.append(low)
            last = low
            continue
        else:
            break
        if not depth:  # at most one operator of each strength waits, and output only grows
            length, tail = len(output), [(op,) for op in reversed(stack)]
    return None if tail is None else output[:length] + tail


def atoms(rpn: list) -> list[str]:
    """Licences of an expression, one with an exception as 'a with e', each once in order of appearance."""
    found: list[str] = []
    for item in rpn:
        if isinstance(item, str):
            found.append(item)
        elif item[0] == "with":
            exception = found.pop()
            found[-1] = f"{found[-1]} with {exception}"
    return list(dict.fromkeys(found))


def holds(rpn: list, granted: Callable[[str], bool]) -> bool:
    """Evaluate: whether the expression is met by the licences for which granted is true; an exception only adds rights."""
    stack: list[bool] = []
    for item in rpn:
        if isinstance(item, str):
            stack.append(granted(item))
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left if item[0] == "with" else left or right if item[0] == "or" else left and right)
    return stack.pop()


def automaton(phrases: dict[str, str], notices: dict[str, str], tags: tuple[str, ...]) -> ahocorasick.Automaton:
    """A phrase may be of two kinds: each entry is a list of (kind, label, length)."""
    entries: dict[str, list] = {}
    for kind, group in (("base", phrases), ("notice", notices), ("tag", dict.fromkeys(tags))):
        for phrase, label in group.items():
            entries.setdefault(f" {phrase} ", []).append((kind, label, len(phrase) + 2))
    found = ahocorasick.Automaton()
    for text, value in entries.items():
        found.add_word(text, value)
    found.make_automaton()
    return found


def scan_text(text: bytes, found: ahocorasick.Automaton) -> tuple[int, list[dict], list[dict]]:
    """Words, hits (kind, start word, label) and tag expressions of one text."""
    parts = text.translate(_TABLE).split()
    if not parts:
        return 0, [], []
    flat = f" {b' '.join(parts).decode('utf-8', 'replace')} "
    hits, expressions = [], []
    at, n = 0, 0
    for last, entry in sorted(((e, v) for e, v in found.iter(flat)), key=lambda x: x[0]):
        for kind, label, size in entry:
            begin = last - size + 1
            if begin < at:
                at, n = 0, 0
            n, at = n + flat.count(" ", at, begin), begin
            hits.append({"kind": kind, "word": n, "label": label})
    if any(h["kind"] == "tag" for h in hits):
        for m in TAG_TEXT.finditer(text):
            line = m[1].decode("utf-8", "replace")
            rpn = parse_expression(line)
            free = rpn is not None and holds(rpn, lambda x: PERMISSIVE_LICENCE.fullmatch(x) is not None)
            expressions.append({"text": line, "valid": rpn is not None, "licences": atoms(rpn) if rpn else [], "permissive": free})
    return len(parts), hits, expressions


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, tags: tuple[str, ...] = TAGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, hits (kind base, notice or tag; start word; label), expressions
    (text behind a tag, whether it starts with a valid expression, its licences, whether permissive ones meet it).

    Null and empty texts have no words and no hits. Repeated rows are scanned each; overlapping hits all count, ordered
    by end. Other columns of docs are not used. An empty table gives an empty result.
    """
    phrases, notices = BASE_PHRASES if phrases is None else phrases, NOTICE_PHRASES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(phrases, notices, tags)
        for batch in slices(batches):
            rows = [scan_text(t.as_buffer().to_pybytes() if t.is_valid else b"", found) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], HITS), pa.array([r[2] for r in rows], EXPRESSIONS)],
                names=["doc_id", "n_words", "hits", "expressions"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


HITS = pa.list_(pa.struct([("kind", pa.string()), ("word", pa.int64()), ("label", pa.string())]))
EXPRESSIONS = pa.list_(pa.struct([("text", pa.string()), ("valid", pa.bool_()), ("licences", pa.list_(pa.string())), ("permissive", pa.bool_())]))


def digest(scanned: DataFrame) -> DataFrame:
    """scan() as columns: n_base, first_word, last_word, base_labels, labels, score, n_expressions."""
    of = lambda kind: F.filter(F.col("hits"), lambda h: h["kind"] == kind)
    base = of("base")
    labels = lambda hits: F.transform(hits, lambda h: h["label"])
    tagged = F.flatten(F.transform(F.col("expressions"), lambda e: e["licences"]))
    all_labels = F.array_sort(F.array_distinct(F.concat(labels(base), labels(of("notice")), tagged)))
    none = F.lit(1.0)
    missing = F.pow(none - WEIGHTS["tag"], F.size(F.filter("expressions", lambda e: e["valid"]))) * F.pow(none - WEIGHTS["base"], F.size(base)) * F.pow(none - WEIGHTS["notice"], F.size(of("notice")))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["word"])).alias("first_word"), F.array_max(F.transform(base, lambda h: h["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels(base))), ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
        (none - missing).alias("score"), F.size("expressions").cast("long").alias("n_expressions"),
    )
