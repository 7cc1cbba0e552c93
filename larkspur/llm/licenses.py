"""Licence scan: sparse TF-IDF cosines of passages to notice templates, then inheritance from the nearest licensed directory.

A passage is a stretch of words as long as a template and laid so that a cue word of both falls together; so headers,
licence files and notices inside long texts are found alike, and texts without any cue word cost one search. Short
licences are templates whole, long ones by their opening; of like licences the one whose own words are there counts. A cosine
does not decide where a version or a condition does: a passage that states another version, or lacks or has a condition by
which relatives differ, is no notice of that template, and of an unknown relative if no other fits. Identifiers in lines of
SPDX are read as they are written. Weights of terms come from counts over all texts. Directories, not files, are matched with licensed ancestors by a path join.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.license_texts import NOTICES, PLAIN_IDS, TEXTS
from larkspur.llm.shared import Table, read_table, rows_in_chunks, through_arrow

#: All templates by licence; each has a cue word (one that begins with licen, or a word of CUES).
TEMPLATES: dict[str, tuple[str, ...]] = {name: (*NOTICES.get(name, ()), *TEXTS.get(name, ())) for name in sorted({*NOTICES, *TEXTS})}
CUES = ("redistribution", "permission", "dedicated", "unlicense", "unencumbered", "cc0")
SIMILAR = 0.8
#: Words from the start in which a notice is a header, and in which a licence's text makes a licence file, as does a notice that is so large a share of the text.
HEADER_WORDS, FILE_WORDS, FILE_SHARE = 200, 40, 0.8
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"
#: Cue words of a template by which it is laid on a text: its first ones.
ANCHORS = 3
#: Rows of one directory each that may be broadcast; more are salted.
BROADCAST_ROWS, SALTS = 500_000, 32

_TERM = re.compile(r"[^\W_]+")
_CUE = re.compile("licen|spdx|" + "|".join(CUES))
#: What is like a template but states another version or other conditions.
UNKNOWN = "unknown"
_SPDX = re.compile(r"SPDX(?:-License-Identifier)?[ \t]*:[ \t]*", re.IGNORECASE)
_ID = re.compile(r"[ \t]*([A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?|[()])")
#: Words that a version follows, in terms.
_VERSIONED = frozenset("version v by nc sa nd cc0 attribution noncommercial sharealike noderivatives license licence gpl lgpl agpl eupl".split())
#: Words that name licences: a notice has those of its template and no others.
_NAMING = frozenset("affero apache artistic attribution boost bsd by cc cc0 commons eclipse epl eupl european general gpl isc lesser library mit mozilla nc nd noncommercial noderivatives sa sharealike unlicense zlib".split())
#: Words from a notice's start in which the conditions stand by which relatives differ, and words behind a passage in which its version may stand.
CONDITIONS, BEHIND = 400, 4
#: Words of a one-line notice, at most.
NOTICE = 20


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def _is_cue(term: str) -> bool:
    return term.startswith("licen") or term in CUES


_TEMPLATES = [(name, terms(t), t in TEXTS.get(name, ())) for name, ts in TEMPLATES.items() for t in ts]
VOCABULARY = frozenset(w for _, t, _ in _TEMPLATES for w in t)


def versions(words: list[str]) -> set[tuple[str, ...]]:
    """Numbers that stand as versions: up to two of up to two digits behind a word such as version."""
    found = set()
    for i, w in enumerate(words):
        run = []
        while len(run) < 2 and w in _VERSIONED and i + 1 + len(run) < len(words) and words[i + 1 + len(run)].isdigit() and len(words[i + 1 + len(run)]) < 3:
            run.append(words[i + 1 + len(run)])
        if run:
            found.add(tuple(run))
    return found


_VERSIONS = [versions(t) for _, t, _ in _TEMPLATES]


def conditions_fit(name: str, after: str) -> bool:
    """Whether a text, in terms, has the conditions of the named licence and none of its relatives'. Where it stops before them, the grant counts."""
    whole, subject, notice = "as is" in after, "subject to the following conditions" in after, "provided that the above copyright notice" in after
    ads, neither = "all advertising materials" in after, "neither the name" in after
    return {
        "MIT": subject or not whole, "MIT-0": whole and not subject, "ISC": notice or not whole, "0BSD": whole and not notice,
        "BSD-2-Clause": not ads and not neither, "BSD-3-Clause": neither and not ads, "BSD-4-Clause": ads,
    }.get(name, True)


def spdx(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, licences) of each line of SPDX: the identifiers of its expression, an exception with the licence that it goes with."""
    for m in _SPDX.finditer(text):
        at, names, operand, joined = m.end(), [], True, False
        while t := _ID.match(text, at):
            token = t[1]
            if token in "()":
                at = t.end()
                continue
            if not operand and token not in ("AND", "OR", "WITH"):
                break
            if operand and not (joined or token in PLAIN_IDS or token.startswith("LicenseRef-") or any(c.isdigit() for c in token)):
                break
            if not operand:
                joined = token == "WITH"
            elif names and joined:
                names[-1] += f" WITH {token}"
            else:
                names.append(token)
            operand, at = not operand, t.end()
        if names:
            yield m.start(), at, list(dict.fromkeys(names))


class Hit(NamedTuple):
    """A passage like a template: its licence, cosine, first word and words, whether it is a licence's text, and the words of the whole text."""

    license: str
    similarity: float
    start: int
    size: int
    is_text: bool
    words: int


class Scanner:
    """Templates that a text holds, with weights log(1 + documents / (1 + documents with the term)); terms outside the templates weigh as unseen ones."""

    def __init__(self, total: int, seen: dict[str, int]) -> None:
        self.idf = {w: math.log(1 + total / (1 + seen.get(w, 0))) for w in VOCABULARY}
        self.other = math.log(1 + total)
        self.at: dict[str, list[tuple[int, int]]] = {}
        self.unit, self.bags = [], []
        for i, (_, words, _) in enumerate(_TEMPLATES):
            self.bags.append(Counter(words))
            v = {w: n * self.idf[w] for w, n in self.bags[i].items()}
            size = math.sqrt(sum(x * x for x in v.values())) or 1.0
            self.unit.append({w: x / size for w, x in v.items()})
            for o, w in [(o, w) for o, w in enumerate(words) if _is_cue(w)][:ANCHORS]:
                self.at.setdefault(w, []).append((i, o))

    def cosine(self, passage: list[str], i: int) -> float:
        v = {w: n * self.idf.get(w, self.other) for w, n in Counter(passage).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return sum(x * self.unit[i].get(w, 0.0) for w, x in v.items()) / size if size else 0.0

    def evidence(self, passage: list[str], i: int) -> float:
        """Weight of the template's words that are there, less that of those that are missing: a whole licence outdoes a line of it, and its own template one with other words."""
        there = Counter(passage)
        return sum((2 * min(n, there[w]) - n) * self.idf[w] for w, n in self.bags[i].items())

    def fits(self, words: list[str], start: int, i: int) -> bool:
        """Whether the passage names the template's licence, in its version if that has one, with its conditions if relatives have others."""
        name, template, is_text = _TEMPLATES[i]
        there, wanted = _NAMING.intersection(words[start : start + len(template)]), _NAMING.intersection(template)
        if not wanted <= there or not is_text and len(template) <= NOTICE and there != wanted:
            return False
        if _VERSIONS[i] and not _VERSIONS[i] & versions(words[start : start + len(template) + BEHIND]):
            return False
        return template[0] not in ("permission", "redistribution") or conditions_fit(name, " ".join(words[start : start + CONDITIONS]))

    def scan(self, text: str) -> list[Hit]:
        """Lines of SPDX, then passages like a template that don't overlap: of overlapping ones that with the most evidence, then the earlier, longer one, then the licence's name; best first, unknown relatives last."""
        if not _CUE.search(text.lower()):
            return []
        words, found, named = terms(text), {}, []
        for start, end, names in spdx(text):
            first, size = len(terms(text[:start])), len(terms(text[start:end]))
            named += [Hit(name, 1.0, first, size, False, len(words)) for name in names]
        for p, w in enumerate(words):
            for i, o in self.at.get(w, ()):
                name, template, is_text = _TEMPLATES[i]
                start, size = max(0, p - o), len(template)
                passage = words[start : p - o + size]
                if (start, i) not in found and (s := self.cosine(passage, i)) >= SIMILAR:
                    fits = self.fits(words, start, i)
                    found[start, i] = (not fits, -round(self.evidence(passage, i), 6), start, -size, name, Hit(name if fits else UNKNOWN, s, start, size, is_text, len(words)))
        out: list[Hit] = named
        for *_, hit in sorted(found.values(), key=lambda x: x[:5]):
            if all(hit.start + hit.size <= x.start or x.start + x.size <= hit.start for x in out):
                out.append(hit)
        return out


def term_counts(files: DataFrame) -> tuple[int, dict[str, int]]:
    """(texts, texts with each term of the vocabulary): a row a term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in rows_in_chunks(batches, 0):
            for text in batch.column(0).to_pylist():
                seen[""] += 1
                seen.update(VOCABULARY.intersection(terms(text)) if text else ())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    found = {r.term: r.n for r in through_arrow(files.select("text"), run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.pop("", 0), found


_SCAN = "id long, path string, license string, similarity double, role string, licenses array<string>"


def _role(path: str | None, hit: Hit) -> str:
    named = path is not None and re.match(FILE_NAME, path.rsplit("/", 1)[-1])
    if named or hit.size >= FILE_SHARE * hit.words or hit.is_text and hit.start < FILE_WORDS:
        return "file"
    return "header" if hit.start < HEADER_WORDS else "body"


def scan_files(files: DataFrame) -> DataFrame:
    """id, path, license, similarity, role (file, header or body) of each text's best notice by its own words, and the licenses of all its notices."""
    scanner = Scanner(*term_counts(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_chunks(batches, 2):
            rows = []
            for number, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hits = scanner.scan(text) if text else []
                best = (hits[0].license, hits[0].similarity, _role(path, hits[0])) if hits else (None, None, None)
                rows.append((number, path, *best, list(dict.fromkeys(h.license for h in hits))))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _SCAN.split(", ")])

    return through_arrow(files.select(F.col("id").cast("long").alias("id"), "path", "text"), run, _SCAN)


def folder(path: str) -> F.Column:
    """Path without its last part; empty at the root."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def _with_nearest(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Rows with what `near` says of their dir; a directory with very many files meets its one row in many tasks."""
    if near.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(near), "dir", "left")
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int")).join(near, ["dir", "salt"], "left").drop("salt")


def licensed_files(files: DataFrame) -> DataFrame:
    """id, path, license, similarity, origin (own or inherited), inherited_from, licenses for every row of `files` (id, path, text).

    A file's own notice counts first, of several a line of SPDX, then the one with the most evidence; `licenses` lists all
    of them. What is like a known licence but states another version or other conditions is `unknown`. Else the
    licence of the nearest directory above that has a licence file counts. Of several licence files in a directory the
    most similar counts, then the first by path, then by licence. Very long texts are scanned whole. Null and empty
    texts have no notice, a null path is the root's; repeated rows are scanned each; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    rows = Table(scan_files(files).withColumn("dir", folder("path")), "scan").df
    owned = rows.where("role = 'file'").groupBy("dir").agg(F.min_by(F.struct("license", "dir"), F.struct(-F.col("similarity"), F.coalesce("path", F.lit("")), "license")).alias("x"))
    owned = owned.select(F.col("dir").alias("above"), "x.license")
    dirs = rows.where("license is null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    steps = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above"))
    near = steps.join(owned, "above").groupBy("dir").agg(F.max_by(F.struct("license", "above"), F.length("above")).alias("x"))
    near = Table(near.select("dir", F.col("x.license").alias("given"), F.col("x.above").alias("inherited_from")), "nearest").df
    out = _with_nearest(rows, near)
    own = F.col("license").isNotNull()
    return out.select(
        "id", "path", F.coalesce("license", "given").alias("license"), "similarity", F.when(own, "own").when(F.col("given").isNotNull(), "inherited").alias("origin"), F.when(~own, F.col("inherited_from")).alias("inherited_from"), "licenses"
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id."""
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licensed_files(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed("id", "doc_id")


QUERIES = {"op1_licenses": op1_licenses}
ORACLES: dict[str, str] = {}
