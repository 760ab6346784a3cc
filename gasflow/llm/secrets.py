"""Secret scans: three plain patterns, and dictionary-primed zstandard novelty.

A candidate is a long string that follows a word for something secret. It is judged by its marginal compressed bytes:
how much longer the compressed text around it becomes by it, when the compressor knows a dictionary of common
identifiers and the text around already. What the dictionary and the surroundings explain costs little; a random string
costs nearly all of its bits and is reported. A value of letters alone may be a word that was not met before: it counts only
behind an explicit sign, and by the bits it adds inside its surroundings, where the letters of common words are cheap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gasflow.llm.blocks import handing_back, row_blocks

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
#: Without one of these, in lower case, a text has no assignment and no candidate.
SENSITIVE = ("passw", "secret", "token", "apikey", "api_key", "api-key", "private", "credential", "bearer", "pwd", "auth")
CANDIDATE = re.compile(
    r"""(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:passw(?:or)?d|secret|token|api[_-]?key|private[_-]?key|credentials?|bearer|pwd|auth(?:orization)?)(?:[_-][A-Za-z0-9_-]{0,64})?["']?\x20{0,4}(?:(?P<sign>[:=]|=>|Bearer|Basic)|is)?[\x20:>=]{0,4}(?:(?:Bearer|Basic)\x20{1,4})?["']?(?P<value>[A-Za-z0-9+/_.=~-]{16,})""",
    re.I | re.A,
)
NEAR = 256
#: Compressed bits a character that a candidate must add to be reported.
LEAST_BITS = 3.0
#: The same for one without digits or marks, measured inside its surroundings. Of random lower-case strings nine in ten add more,
#: of strings of both cases nearly all; of long words half add less than 5, one in ten more than 7.5 (100 of each, in texts of sf0.01).
LEAST_BITS_OF_LETTERS = 6.5
IDENTIFIERS = " ".join(
    f"{a}{b}{c}"
    for a in ("get", "set", "is", "new", "load", "read", "write", "default", "example", "your", "my", "test", "user", "client")
    for b in ("", "_", "-", ".")
    for c in ("token", "secret", "password", "key", "api", "auth", "config", "value", "string", "name", "id", "file", "path", "url")
) + " ".join(
    ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "xxxxxxxxxxxxxxxx", "0000000000000000", "placeholder", "changeme")
    + ("process.env", "os.environ", "getenv", "application", "authorization", "authentication", "authenticated", "credentials", "https://", "example.com")
)


class Novelty:
    """Marginal compressed bits of a string in its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        self.identifiers = identifiers.encode()

    def bits(self, before: bytes, value: bytes, after: bytes) -> float:
        """Bits per character that ``value`` adds between ``before`` and ``after``."""
        known = zstandard.ZstdCompressionDict(self.identifiers + before + after, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=19, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        return 8 * (len(compressor.compress(value)) - len(compressor.compress(b""))) / max(len(value), 1)

    def bits_inside(self, before: bytes, value: bytes, after: bytes) -> float:
        """Bits per character by which the compressed surroundings grow when ``value`` stands in them."""
        known = zstandard.ZstdCompressionDict(self.identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=19, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        return 8 * (len(compressor.compress(before + value + after)) - len(compressor.compress(before + after))) / max(len(value), 1)


def base_spans(text: str, lower: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the plain patterns; leftmost without overlap in each kind."""
    out = []
    if any(w in lower for w in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def novel_spans(text: str, lower: str, novelty: Novelty, least: float = LEAST_BITS) -> list[tuple[int, int, int]]:
    """Candidates that the dictionary and their surroundings do not explain."""
    out = []
    if any(w in lower for w in SENSITIVE):
        for m in CANDIDATE.finditer(text):
            value, (start, end) = m["value"], m.span("value")
            around = [s.encode("utf-8", "replace") for s in (text[max(0, start - NEAR) : start], value, text[end : end + NEAR])]
            if any(c.isdigit() for c in value) or (value != value.lower() and value != value.upper() and not value.isalpha()):
                novel = novelty.bits(*around) >= least
            else:
                novel = m["sign"] is not None and novelty.bits(*around) >= least and novelty.bits_inside(*around) >= LEAST_BITS_OF_LETTERS
            if novel:
                out.append((start, 3, end))
    return out


SPAN = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame, text: str = "text", least_bits: float = LEAST_BITS) -> DataFrame:
    """The documents with ``secrets``: kind, start and end (code points, end exclusive) by start, then kind.

    Whole texts are scanned, each for itself, so nothing is shuffled and repeated rows stay. A null text has none. A
    candidate of the novelty method inside a span of a plain pattern is left to that. Other columns are
    kept; one named ``secrets`` is replaced. An empty table gives no rows.
    """
    frame = docs.drop("secrets")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema), f"secrets {SPAN}"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            for rows, texts in row_blocks(batch, text):
                found = []
                for t in (raw.decode("utf-8", "replace") for raw in texts):
                    lower = t.lower()
                    base = base_spans(t, lower)
                    new = [s for s in novel_spans(t, lower, novelty, least_bits) if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]
                    found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + new)])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, kind)], names=[*rows.schema.names, "secrets"])

    return frame.mapInArrow(handing_back(scan), schema)


def secret_digest(found: DataFrame) -> DataFrame:
    """Add counts per plain kind, the digest of the plain spans, and all spans as one string."""
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    plain = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.withColumns(
        {
            **{f"n_{k}": count(k) for k in KINDS},
            "base_sha256": F.sha2(F.array_join(F.transform(plain, written), ","), 256),
            "spans": F.array_join(F.transform("secrets", written), ","),
        }
    )


def masked(found: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with each secret replaced by ``mark`` in their text; overlapping spans are replaced as one."""
    pieces = F.aggregate(
        "secrets",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["done"])
            .otherwise(F.concat(acc["done"], F.col(text).substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
            .alias("done"),
        ),
        lambda acc: F.concat(acc["done"], F.col(text).substr((acc["at"] + 1).cast("int"), F.length(text))),
    )
    return found.withColumn(text, F.when(F.size("secrets") > 0, pieces).otherwise(F.col(text)))
