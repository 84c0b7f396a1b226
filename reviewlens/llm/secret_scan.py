"""Secret scans by dictionary-primed zstandard novelty.

Three base kinds are decided by pattern and length: assigned values, access key ids and long hex runs. Beyond them,
every token that could be a credential and stands in a sensitive context is measured: the bytes it adds to a
compressed frame of its surroundings, where the compressor is primed with a dictionary of identifiers, next to its
length. Words, identifiers and repeated values are found in the dictionary or around the token and cost little;
random strings cost nearly all their entropy and are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import bounded_batches

KINDS = ("assign", "access", "hex", "novel")
AROUND = 256
CONTEXT = 60
NOVELTY = 0.6
#: Long words of letters alone can be nearly as new as a random string, so these need more.
LETTER_NOVELTY = 0.95

ASSIGN = re.compile(
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ASSIGN_SIGNS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Tokens that can be credentials: long runs with a letter in them.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(
    r"(?:passw|pwd|secret|token|api.?key|access.?key|private.?key|credential|bearer|authorization|auth|signature|"
    r"client.?id|cookie|session|login|aws|ssh|-----begin)",
    re.ASCII | re.IGNORECASE,
)

#: Names that are common in code and configuration; they prime the compressor.
IDENTIFIERS = (
    "abstract access account address after api_key application argument array async attribute auth authorization "
    "await base64 bearer before begin boolean break buffer build cache callback case catch certificate channel char "
    "class client client_id client_secret code column commit config connect connection const constructor container "
    "content context continue cookie count create credential current cursor database date debug decode default "
    "delete description digest directory disable double download driver element else enable encode encrypt endpoint "
    "entry enum environment error event example except exception execute export extends false field file filename "
    "filter final finally float folder follow format from function generate get handler hash header host http https "
    "identifier image implements import include index info initialize input insert instance integer interface "
    "internal iterator json key keyword label lambda language length level library license list listener local "
    "location login logger long main manager map master message metadata method middleware model module name "
    "namespace network node null number object offset operation option output package page parameter parent parse "
    "password path pattern payload permission platform plugin pointer port position primary print priority private "
    "private_key process profile property protected protocol provider proxy public public_key query queue random "
    "read record reference refresh_token region register release remote remove replace repository request require "
    "reset resource response result return role route schema scope script search secret security select self send "
    "sequence server service session set setting signature size socket source start state static status stop "
    "storage stream string struct subject submit super switch symbol synchronized system table target task template "
    "test text thread throw time timeout timestamp title token trace transaction true type undefined union unique "
    "update upload url user username utf8 uuid validate value variable vector verify version view virtual void "
    "volatile warning webhook while width window worker write 0123456789 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
).encode()


class Novelty:
    """Marginal compressed bytes of tokens; one per task."""

    def __init__(self, identifiers: bytes = IDENTIFIERS) -> None:
        primer = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._compressor = zstandard.ZstdCompressor(
            level=9, dict_data=primer, write_content_size=False, write_checksum=False
        )

    def _size(self, data: bytes) -> int:
        return len(self._compressor.compress(data))

    def of(self, before: str, token: str, after: str) -> float:
        """Bytes the token adds to its compressed surroundings, per byte of the token."""
        around = f"{before} {after} ".encode()
        return (self._size(around + token.encode()) - self._size(around)) / len(token)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds, by start and then kind; kinds don't hide each other."""
    spans = []
    lower = text.lower()
    if any(sign in lower for sign in ASSIGN_SIGNS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def novel_spans(
    text: str, base: list[tuple[int, int, int]], novelty: Novelty, limit: float = NOVELTY, letter_limit: float = LETTER_NOVELTY,
    context: int = CONTEXT, around: int = AROUND,
) -> list[tuple[int, int, int]]:
    """Incompressible tokens in a sensitive context that touch no base span."""
    out = []
    if SENSITIVE.search(text) is None:
        return out
    taken = 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while taken < len(base) and base[taken][2] <= start and taken + 1 < len(base):
            taken += 1
        if any(a < end and start < b for a, _, b in base[max(0, taken - 2) : taken + 3]):
            continue
        if SENSITIVE.search(text, max(0, start - context), start) is None:
            continue
        least = limit if any(c.isdigit() for c in m[0]) else letter_limit
        if novelty.of(text[max(0, start - around) : start], m[0], text[end : end + around]) >= least:
            out.append((start, 3, end))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])


def scan_secrets(
    docs: DataFrame, *, text_col: str = "text", limit: float = NOVELTY, letter_limit: float = LETTER_NOVELTY,
    context: int = CONTEXT, around: int = AROUND, identifiers: bytes = IDENTIFIERS,
) -> DataFrame:
    """Each row with `secrets`: spans (start, end, kind) by start and then kind, in code points, end exclusive.

    An added column replaces one of its name. Null and empty texts have none. Repeated rows are scanned each; a text is
    scanned whole. Base kinds are always reported, overlapping or not; a novel span touches no base span.
    `identifiers` is the dictionary that primes the compressor; a sensitive word must stand at most `context` characters
    before a token, which is measured among `around` characters on both sides.
    """

    @F.arrow_udf(returnType="array<struct<start: long, end: long, kind: string>>")
    def spans(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty = Novelty(identifiers)
        for part in parts:
            rows = []
            for text in part.to_pylist():
                base = base_spans(text) if text else []
                found = sorted(base + novel_spans(text, base, novelty, limit, letter_limit, context, around)) if text else []
                rows.append([{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in found])
            yield pa.array(rows, type=pa.list_(_SPAN))

    kept = [c for c in docs.columns if c != "secrets"]
    return bounded_batches(docs).select(*kept, spans(F.col(text_col)).alias("secrets"))
