"""Secret scans: fixed patterns, and novelty against a primed zstandard dictionary.

The patterns give the spans that any scan must give. Beside them, strings that
stand in a sensitive context are measured: how many bytes does the string add to
the compressed surroundings when the compressor already knows common code and
identifiers? Ordinary words and repeated names add little; random keys cost
nearly what they are long, and are reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, renamed

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "novel")
#: Fixed patterns and least lengths.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX = re.compile(r"[0-9a-f]{32,}")
#: What makes a place sensitive, and how far before a string it may stand.
SENSITIVE = re.compile(r"(?ai)pass(?:wd|word|phrase|code)|pwd|secret|token|key|auth|credential|bearer|private|signature|session|cookie|akia|gh[pousr]_|xox[abprs]-|sk[-_]live|eyj[a-z0-9]")
REACH = 96
#: A candidate: shorter strings add about as many compressed bytes as they have, words and keys alike, and are left to the patterns.
LEAST_CANDIDATE = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.~-]{{{LEAST_CANDIDATE},}}")
_MORE, _ONE = re.compile(r"[A-Za-z0-9+/_=.~-]*"), re.compile(r"[A-Za-z0-9+/_=.~-]")
#: Surroundings taken on each side of a candidate, in characters.
AROUND = 200
#: A string is novel if it adds at least this many compressed bytes for each of its own.
NOVEL_SHARE = 0.72

#: Fixed text that primes the compressor: identifiers and phrases that are common near secrets without being secret.
PRIMER = (
    "password passwd passphrase username user_name login secret secret_key client_secret client_id token access_token refresh_token id_token "
    "api_key apikey api-key x-api-key authorization Authorization: Bearer Basic credentials credential private_key public_key PRIVATE KEY PUBLIC KEY "
    "-----BEGIN RSA PRIVATE KEY----- -----END RSA PRIVATE KEY----- -----BEGIN CERTIFICATE----- -----END CERTIFICATE----- ssh-rsa session_id session_token cookie Set-Cookie "
    "signature hmac sha256 sha512 md5 aws_access_key_id aws_secret_access_key AWS_REGION us-east-1 GITHUB_TOKEN github_pat database_url postgres:// mysql:// mongodb:// redis:// "
    "http:// https:// localhost 127.0.0.1 example.com www. .com .org .net .html .json .yaml .txt /usr/local/bin /home/user /var/log "
    "import os from sys def class return self None True False const let var function public static void private string int float null undefined "
    "environment variable config configuration settings development production staging test example sample default changeme placeholder your_api_key_here "
    "xxxxxxxxxxxxxxxx 0000000000000000 1234567890 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, leftmost and not overlapping within a kind, in code points."""
    found: list[Span] = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


class Novelty:
    """Marginal compressed size of a string within its surroundings."""

    def __init__(self, primer: str = PRIMER, level: int = 6):
        primed = zstandard.ZstdCompressionDict(primer.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._press = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False)

    def share(self, before: str, string: str, after: str) -> float:
        """Compressed bytes that ``string`` adds between its surroundings, for each byte of its own."""
        around, own = (before + " " + after).encode(), string.encode()
        added = len(self._press.compress(around + b"\n" + own)) - len(self._press.compress(around + b"\n"))
        return added / max(1, len(own))


def novel_spans(text: str, novelty: Novelty, threshold: float = NOVEL_SHARE) -> list[Span]:
    """Incompressible strings that follow a sensitive word within ``REACH`` characters (or hold it): every candidate is measured, whatever it is made of.

    Each sensitive word is looked past ``REACH`` once, so the time is in proportion to the text.
    """
    found: list[Span] = []
    done = 0
    for near in SENSITIVE.finditer(text):
        at, stop = max(done, near.start()), near.end() + REACH
        # a candidate may begin before the word that marks it
        while at > done and _ONE.match(text[at - 1]):
            at -= 1
        # what begins before ``stop`` has its least length before that end
        while m := CANDIDATE.search(text, at, stop + LEAST_CANDIDATE - 1):
            start, end = m.start(), _MORE.match(text, m.end()).end()
            at = done = end
            if novelty.share(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND]) >= threshold:
                found.append(("novel", start, end))
    return found


def all_spans(text: str, novelty: Novelty, threshold: float = NOVEL_SHARE) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, and all spans, both by start and then kind; a novel string inside a pattern's span is not told twice."""
    if not (SENSITIVE.search(text) or HEX.search(text)):
        return [], []
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    more = [s for s in novel_spans(text, novelty, threshold) if not any(b[1] <= s[1] and s[2] <= b[2] for b in base)]
    return base, sorted(base + more, key=order)


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every span replaced by ``mark``; overlapping spans become one mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = NOVEL_SHARE) -> DataFrame:
    """One row for each row: key, n_assign, n_access, n_hex, base_sha256, spans and n_novel.

    A null text counts as empty: no spans, and the digest of the empty string.
    Null keys and repeated rows pass through. Other columns are ignored. A text is
    scanned whole, in one Arrow batch with others; nothing is shuffled.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("k", kind), *[T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_novel", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            rows = []
            for value in batch.column(1):
                base, every = all_spans(value.as_py() or "", novelty, threshold)
                kinds = [s[0] for s in every]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(told(base).encode()).hexdigest(), told(every), kinds.count("novel")))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["k", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(released(run), schema).withColumnRenamed("k", key)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", threshold: float = NOVEL_SHARE) -> DataFrame:
    """All rows and columns of ``docs`` with the secrets of ``text`` replaced; ``length``, if there is such a column, is counted anew where a text changed.

    Null texts stay null, empty ones empty; repeated rows are each redacted; an empty
    table gives an empty one; columns of any name, also twice, stay as they are.
    """
    mine, names = renamed(docs)
    at, count = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            changed: dict[int, str] = {}
            for i, value in enumerate(batch.column(at)):
                text = value.as_py()
                if text and (spans := all_spans(text, novelty, threshold)[1]):
                    changed[i] = redacted(text, spans)
            if changed:  # a few rows: the others are not copied one by one
                mask = np.zeros(batch.num_rows, dtype=bool)
                mask[list(changed)] = True
                columns = list(batch.columns)
                columns[at] = pc.replace_with_mask(columns[at], pa.array(mask), pa.array(list(changed.values()), columns[at].type))
                if count is not None:
                    columns[count] = pc.replace_with_mask(columns[count], pa.array(mask), pa.array([len(x) for x in changed.values()], columns[count].type))
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return mine.mapInArrow(released(run), mine.schema).toDF(*docs.columns)
