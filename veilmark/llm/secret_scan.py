"""Secret scan: fixed patterns, and a token-efficiency test for random strings that no pattern names.

A random string breaks into many short tokens of a byte-pair vocabulary, a word or a name into few long ones. So a
candidate run of letters and digits whose characters per token stay under a limit is reported, once known digests
(plain hex of a digest's length), UUIDs, runs without a letter and identifiers (words joined by case, slashes or
underscores) are out. The vocabulary tells words from random letters: a word has WORD characters per token at least.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, texts_of

#: The base patterns of this scan.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: How byte-level BPE vocabularies cut a text before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Hex lengths of the usual digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = (32, 40, 56, 64, 96, 128)

KINDS = ("assign", "access", "hex", "random")
#: Characters per token of a word in an identifier; of random letters, most tokens hold one or two.
WORD = 3.0
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_WORDS = ("passw", "secret", "token", "api")
_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(ACCESS)
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=table, special_tokens={})


def tokens(text: str, encoding) -> int:
    return max(1, len(encoding.encode_ordinary(text)))


def excluded(run: str, encoding) -> bool:
    """Digests, UUIDs and identifiers: what looks random or long and is no secret."""
    hexed = len(run) in DIGESTS and all(c in "0123456789abcdef" for c in run.lower())
    if hexed or _UUID.fullmatch(run):
        return True
    digits = sum(c.isdigit() for c in run)
    letters = sum(c.isalpha() for c in run)
    if not letters:
        return True
    words = [w for w in _PARTS.findall(run) if len(w) >= 4 and w.isalpha()]
    if sum(map(len, words)) < 0.5 * letters or digits >= 0.3 * len(run):
        return False
    return all(len(w) >= WORD * min(tokens(w, encoding), tokens(w.lower(), encoding)) for w in words)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, encoding, most: float) -> list[tuple[int, int, int]]:
    runs = [m for m in _RUN.finditer(text) if m.end() - m.start() <= most * tokens(m.group(), encoding)]
    return [(m.start(), 3, m.end()) for m in runs if not excluded(m.group(), encoding)]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, chars_per_token: float = 1.9) -> DataFrame:
    """One row per row of `docs`: the id and `secrets`, an array of (kind, start, end, value) by start, then kind.

    Offsets count code points, ends are exclusive. A null or empty text has an empty array, repeated rows each get
    their row, an empty table gives none, and further columns are not read. A random run that touches a base span
    isn't reported again. `vocabulary` is a file of tiktoken ranks on the driver; its size is the vocabulary's.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def work(part: pa.RecordBatch) -> dict:
        encoding = _encoding(ranks.value)
        rows = []
        for text in texts_of(part.column(1)):
            base = base_spans(text)
            more = [r for r in random_spans(text, encoding, chars_per_token) if not any(b[0] < r[2] and r[0] < b[2] for b in base)]
            rows.append([{"kind": KINDS[k], "start": s, "end": e, "value": text[s:e]} for s, k, e in sorted(base + more)])
        return {"id": part.column(0), "secrets": pa.array(rows, type=span)}

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_slices(inner, "text", f"id {kind}, secrets array<struct<kind:string,start:bigint,end:bigint,value:string>>", work)
    return out.withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, the hash of the base spans and the list of all spans."""
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(id_col, count("assign"), count("access"), count("hex"), count("random"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
