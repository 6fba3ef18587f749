"""Secret scans (operator 9): fixed patterns, and strings that a zstandard coder finds new, primed with what surrounds them and with the identifiers of the corpus."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermal_lake.llm.common import map_arrow, replace_arrow, unused

#: The base patterns and how long a match has to be (group 2 for assign).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
HEX_DIGITS = re.compile(r"[0-9a-f]+|[0-9A-F]+")
KINDS = ("assign", "access", "hex", "novel")

#: A candidate: a run of key-like characters, as long as this at least; several of them joined by dots are one.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}(?:\.[A-Za-z0-9+/_=-]{8,})+|[A-Za-z0-9+/_=-]{16,}")
#: A candidate of letters alone doesn't read like words if it has as many consonants in a row, or as large a share of changes between upper and lower case.
CONSONANTS, CHANGES = re.compile(r"[b-df-hj-np-tv-xz]{5}", re.I), 0.4
#: Words that make what follows them sensitive, within so many characters.
SENSITIVE = re.compile(r"passw|secret|token|api.?key|private|credential|auth|bearer|access|signature|key", re.A | re.I)
CONTEXT = 64
#: Characters around a candidate that prime the coder.
AROUND = 512
#: Marginal compressed bytes a character from which a candidate is reported (random base64 text needs 0.75, hex digits 0.5).
NOVELTY = 0.6
#: Characters from which a candidate's alphabet counts: shorter ones take about a byte a character whatever they hold.
LONG = 64
#: Identifiers of the corpus (with an underscore or a hump), the parts that are learnt of them, and how many of these prime the coder besides: the most frequent ones. Parts are shorter than any candidate, so no secret is learnt.
IDENTIFIER, PART = re.compile(r"[A-Za-z]+_[A-Za-z_]*|[a-z]+[A-Z][A-Za-z]*"), re.compile(r"[A-Z]?[a-z]{2,14}|[A-Z]{3,15}")
PARTS = 2000
#: Distinct parts that a counting task holds before it hands on what it has.
HELD = 300_000
#: Identifiers that prime the coder whatever the corpus holds, as they stand in code.
IDENTIFIERS = (
    "self return import from class def function const let var public private static final void int string boolean float double null None true false "
    "password passwd secret token api_key apikey access_key secret_key private_key client_secret client_id authorization bearer credential signature "
    "username user_name email address config settings environment variable default value example placeholder changeme your_token_here "
    "http https www com org net localhost request response header content type application json xml html text plain utf-8 base64 sha256 md5 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef "
)


def parts_of(text: str) -> list[str]:
    """The parts of a text's identifiers, in lower case."""
    return [p.lower() for i in IDENTIFIER.findall(text) for p in PART.findall(i)]


def learn_identifiers(df: DataFrame, text_col: str = "text", parts: int = PARTS) -> str:
    """The dictionary that primes the coder: the most frequent parts of all texts' identifiers, frequent ones last, and IDENTIFIERS. What the driver gets is bounded by `parts`."""

    def kernel(batches) -> Iterator[dict]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update(parts_of(text))
            if len(held) > HELD:
                yield {"part": list(held), "n": list(held.values())}
                held.clear()
        yield {"part": list(held), "n": list(held.values())}

    counts = map_arrow(df.select(df[text_col].alias("text")), "part string, n long", kernel).groupBy("part").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "part").limit(parts).collect()
    return " ".join([r["part"] for r in reversed(found)] + [IDENTIFIERS])


class Novelty:
    """Marginal compressed bytes of a string after its surroundings, by a coder primed with identifiers."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        self.primer = identifiers.encode()
        self.level = level

    def __call__(self, before: str, candidate: str, after: str) -> float:
        primed = zstandard.ZstdCompressionDict(self.primer + after.encode() + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coder = zstandard.ZstdCompressor(level=self.level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        label = before[-CONTEXT:].encode()
        return (len(coder.compress(label + candidate.encode())) - len(coder.compress(label))) / len(candidate)


def unwordly(s: str) -> bool:
    """Letters (and signs) that don't read like words."""
    letters = "".join(c for c in s if c.isalpha())
    changes = sum(a.isupper() != b.isupper() for a, b in zip(letters, letters[1:], strict=False))
    return len(letters) >= 16 and (CONSONANTS.search(letters) is not None or changes >= CHANGES * len(letters))


def mixed(s: str) -> bool:
    """Digits and letters, both."""
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping in each kind."""
    out: list[tuple[int, str, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def bits(s: str) -> float:
    """Bits that a random character of the candidate's alphabet has: hex digits, digits and letters of one case, or all."""
    if s != s.lower() and s != s.upper():
        return 6.0
    return 4.0 if HEX_DIGITS.fullmatch(s) else math.log2(36)


def least_novelty(s: str, threshold: float = NOVELTY) -> float:
    """The threshold, which is meant for 6 bits a character, for this candidate's length and alphabet."""
    return threshold if len(s) < LONG else threshold * bits(s) / 6


def without_copies(text: str, at: int, copy: str) -> str:
    """The AROUND characters from a place on, with copies of a string blank, those that the end cuts too."""
    return text[at : at + AROUND + len(copy) - 1].replace(copy, " " * len(copy))[:AROUND]


def novel_spans(text: str, novelty: Novelty, taken: list[tuple[int, str, int]], threshold: float = NOVELTY) -> list[tuple[int, str, int]]:
    """Incompressible candidates after a sensitive word that no base span covers, and all copies of these. Copies after a candidate don't make it old, those before it do. A candidate has digits and letters, or letters that don't read like words."""
    found = [(*m.span(), m[0]) for m in CANDIDATE.finditer(text) if (mixed(m[0]) or unwordly(m[0])) and not any(a <= m.start() and m.end() <= b for a, _, b in taken)]
    new: set[str] = set()
    for s, e, x in found:
        if x not in new and SENSITIVE.search(text, max(0, s - CONTEXT), s) and novelty(text[max(0, s - AROUND) : s], x, without_copies(text, e, x)) >= least_novelty(x, threshold):
            new.add(x)
    return [(s, "novel", e) for s, e, x in found if x in new]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = NOVELTY, redacted: bool = False, identifiers: str | None = None) -> DataFrame:
    """Spans of secrets in every whole text (code points, end exclusive), one row for each row of df.

    df may have any further columns; they are not read. Null text counts as empty and has no spans. A null id stays
    null; repeated rows each give a row; an empty table gives an empty table. Columns: the id, n_assign, n_access,
    n_hex, n_novel (long), base_spans and spans (kind:start:end by start, then kind, comma-joined), base_sha256.
    redacted=True adds the text with each span replaced by [kind]. identifiers primes the coder; None: learnt from df, in a pass of its own.
    """
    known = learn_identifiers(df, text_col) if identifiers is None else identifiers
    schema = "id long, n_assign long, n_access long, n_hex long, n_novel long, base_spans string, base_sha256 string, spans string" + ", redacted string" * redacted

    def kernel(batches) -> Iterator[dict]:
        novelty = Novelty(known)
        for batch in batches:
            names = ("n_assign", "n_access", "n_hex", "n_novel", "base_spans", "base_sha256", "spans", "redacted")
            out: dict = {"id": batch.column(0)} | {k: [] for k in names}
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                novel = novel_spans(text, novelty, base, threshold)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(x[1] == k for x in (*base, *novel)))
                out["base_spans"].append(joined(base))
                out["base_sha256"].append(hashlib.sha256(out["base_spans"][-1].encode()).hexdigest())
                out["spans"].append(joined([*base, *novel]))
                if redacted:
                    out["redacted"].append(redact(text, [*base, *novel]))
            yield out

    return map_arrow(df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")), schema, kernel).withColumnRenamed("id", id_col)


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with spans replaced by [kind]; of overlapping spans, the union under the first one's kind."""
    out, at = [], 0
    for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))):
        if s >= at:
            out += [text[at:s], f"[{k}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_texts(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", threshold: float = NOVELTY, identifiers: str | None = None) -> DataFrame:
    """df with each secret in text_col replaced by [kind], and chars_col (if df has it) by the new length where the text changed. Null texts and all other columns stay."""
    known = learn_identifiers(df, text_col) if identifiers is None else identifiers

    def clean() -> Callable[[str], str]:
        novelty = Novelty(known)

        def one(text: str) -> str:
            base = base_spans(text)
            return redact(text, [*base, *novel_spans(text, novelty, base, threshold)])

        return one

    changed = unused(df, "_text_changed")
    out = replace_arrow(df, text_col, clean, changed)
    if chars_col in df.columns:
        kind = df.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col(changed), F.length(F.col(text_col)).cast(kind)).otherwise(F.col(chars_col)))
    return out.drop(changed)
