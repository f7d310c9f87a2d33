r"""Secret scans: fixed patterns, and dictionary-primed compression novelty.

Three patterns find secrets of known form. Beside them, long strings that stand
after a sensitive word are compressed with a dictionary made of common
identifiers and of the text around them; the bytes that a string adds, against
its length, say how novel it is. Random keys hardly compress and are reported,
words and identifiers are not.

A candidate is a run of 16 or more characters of keys, without the full stop or
exclamation mark that may end it, that mixes kinds of characters (``mixed``).

Null and empty texts have no spans. Each row gives one row, repeated rows and
null ids too; an empty table gives none. Spans count code points, end exclusive;
a span is the whole match. Memory follows one text, however long. Other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import text_groups, word_limits

# The base patterns and the least length of what they must match.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "novel")

# Words after which a string may be a secret.
SENSITIVE = re.compile(rb"(?i:key|auth|bearer|credential|pwd|passphrase|passwd|password|private|session|signature|cookie|secret|token|login)")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=.!@#$%^&*~-]{16,}")
#: What may end a sentence behind a string.
TAIL = b".!"
#: A sensitive word, the rest of its name and what parts it from a value.
NAMED = re.compile(SENSITIVE.pattern + rb"(?:[A-Za-z0-9_-]{0,16}?=+|_)")
MIN_NOVEL = 16

# Identifiers that prime the compressor.
IDENTIFIERS = b" ".join(
    b"""access account address algorithm application argument array attribute authorization base64 boolean buffer callback
    client column command config connection constant content context controller count create credentials data database default
    delete description digest directory document domain element encoding endpoint environment error event example exception
    expires field filename filter format function generate global handler hash header host identifier import include index input
    instance integer interface internal iterator json key label length library license list local login manager message method
    module name namespace node object offset option output package parameter parent password path payload pattern permission
    placeholder port prefix private process property protocol provider public query random record reference release remote
    request resource response result return row schema secret sequence server service session signature source standard state
    static status storage stream string struct suffix system table target template timeout timestamp token type update url user
    username utf-8 value variable version void http https www com org net 0123456789 abcdefghijklmnopqrstuvwxyz
    ABCDEFGHIJKLMNOPQRSTUVWXYZ""".split()
)

_HEX_GAP = np.ones(256, dtype=bool)
_HEX_GAP[[*b"0123456789abcdef"]] = False


def base_spans(raw: bytes, lowered: bytes, hex_runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind index, end) in bytes of the base patterns."""
    found = [(s, 2, e) for s, e in hex_runs]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= MIN_ACCESS]
    if b"pass" in lowered or b"token" in lowered or b"secret" in lowered or b"key" in lowered:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    return sorted(found)


def novelty(candidate: bytes, around: bytes) -> float:
    """Bytes that ``candidate`` adds to a compressor primed with its surroundings, per byte of it."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)
    empty = len(compressor.compress(around))
    return (len(compressor.compress(around + candidate)) - empty) / max(len(candidate), 1)


def mixed(own: bytes) -> bool:
    """Whether a string mixes kinds of characters as keys do: letters with digits or signs, or letters of both cases in no order.

    Words, names joined by ``_``, ``-`` or ``.``, and names in camel case are not mixed.
    """
    letters, digits = re.search(rb"[A-Za-z]", own), re.search(rb"[0-9]", own)
    if letters and (digits or re.search(rb"[+/=!@#$%^&*~]", own[:-2])) or digits and re.search(rb"[!@#$%^&*~]", own):
        return True
    turns = sum(a.islower() != b.islower() for a, b in zip(own.decode(), own.decode()[1:], strict=False) if a.isalpha() and b.isalpha())
    return turns >= 0.3 * len(own)


def value_start(own: bytes, led: bool) -> int | None:
    """Where the value begins in a run that may hold its own name (``key=value``); None if there is none.

    ``led`` says that a sensitive word stands before the run, which then may be the value as a whole.
    """
    last = len(own) - MIN_NOVEL
    named = [m.end() for m in NAMED.finditer(own) if m.end() <= last]
    if named:
        return named[-1]
    word = SENSITIVE.search(own)
    if word and word.end() <= last and (not led or word.start() == 0):
        return word.end()
    return 0 if led else None


def surroundings(raw: bytes, s: int, e: int, window: int) -> bytes:
    """Up to ``window`` bytes on each side, without copies of the string itself, whole or cut by the window's ends."""
    own, a, z = raw[s:e], max(0, s - window), min(len(raw), e + window)
    at = raw.find(own, max(0, a - len(own) + 1), min(s, a + len(own) - 1))
    a = at + len(own) if 0 <= at < a else a
    at = raw.rfind(own, max(e, z - len(own) + 1), z + len(own) - 1)
    z = at if 0 <= at < z < at + len(own) else z
    return raw[a:s].replace(own, b"") + raw[e:z].replace(own, b"")


def novel_spans(raw: bytes, taken: list[tuple[int, int, int]], reach: int, window: int, least: float) -> list[tuple[int, int, int]]:
    """Incompressible strings that begin within ``reach`` bytes after a sensitive word, or follow it in one run, and overlap no base span."""
    words = [m.end() for m in SENSITIVE.finditer(raw)]
    starts = [s for s, _, _ in taken]
    furthest = list(accumulate((e for _, _, e in taken), max))
    found: list[tuple[int, int, int]] = []
    for m in CANDIDATE.finditer(raw) if words else ():
        own = m.group().rstrip(TAIL)
        s, e = m.start(), m.start() + len(own)
        if len(own) < MIN_NOVEL:
            continue
        before = bisect_right(words, s)
        start = value_start(own, bool(before) and s - words[before - 1] <= reach)
        if start is None:
            continue
        s, own = s + start, own[start:]
        base = bisect_left(starts, e)
        if base and furthest[base - 1] > s or not mixed(own):
            continue
        if novelty(own, surroundings(raw, s, e, window)) >= least:
            found.append((s, 3, e))
    return found


def _text_spans(raw: bytes, hex_runs: list[tuple[int, int]], reach: int, window: int, least: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    lowered = raw.lower()
    base = base_spans(raw, lowered, hex_runs)
    more = novel_spans(raw, base, reach, window, least)
    every = sorted(base + more)
    if every and not raw.isascii():
        cuts = sorted({x for s, _, e in every for x in (s, e)})
        points, last, count = {}, 0, 0
        for cut in cuts:
            count += len(raw[last:cut].decode("utf-8", "surrogatepass"))
            points[cut], last = count, cut
        every = [(points[s], k, points[e]) for s, k, e in every]
        base = [(points[s], k, points[e]) for s, k, e in base]
    return base, every


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 48, window: int = 256, least_novelty: float = 0.72) -> DataFrame:
    """One row per document: counts by kind, ``base_sha256``, ``spans`` and ``n_novel`` (count of what novelty finds)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for raw in text_groups(x.as_py() for x in batch.column("text")):
                data = np.frombuffer(b" ".join(raw), dtype=np.uint8)
                offsets = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw])))
                starts, ends = word_limits(data, _HEX_GAP)
                long = ends - starts >= MIN_HEX
                starts, ends = starts[long], ends[long]
                owner = np.searchsorted(offsets, starts, side="right") - 1
                runs: dict[int, list[tuple[int, int]]] = {}
                for d, s, e in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    runs.setdefault(d, []).append((s - int(offsets[d]), e - int(offsets[d])))
                rows = [_text_spans(x, runs.get(i, []), reach, window, least_novelty) for i, x in enumerate(raw)]
                counts = [[sum(k == kind for _, k, _ in every) for _, every in rows] for kind in range(4)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(at, len(raw)),
                        "n_assign": pa.array(counts[0], pa.int64()),
                        "n_access": pa.array(counts[1], pa.int64()),
                        "n_hex": pa.array(counts[2], pa.int64()),
                        "n_novel": pa.array(counts[3], pa.int64()),
                        "base_sha256": pa.array([hashlib.sha256(spans_text(b).encode()).hexdigest() for b, _ in rows], pa.string()),
                        "spans": pa.array([spans_text(e) for _, e in rows], pa.string()),
                    }
                )
                at += len(raw)

    return source.mapInArrow(run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every span of their texts replaced by ``mask``; all other columns as they are."""
    reach, window, least = options.get("reach", 48), options.get("window", 256), options.get("least_novelty", 0.72)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hex_run = re.compile(rb"[0-9a-f]{%d,}" % MIN_HEX)
        for batch in batches:
            texts = []
            for x in batch.column(text_col):
                text = x.as_py()
                if text is not None:
                    raw = text.encode("utf-8", "surrogatepass")
                    _, every = _text_spans(raw, [m.span() for m in hex_run.finditer(raw)], reach, window, least)
                    out, last = [], 0
                    for s, _, e in every:
                        if e > last:
                            out += [text[last : max(s, last)], mask] if s >= last else []
                            last = e
                    text = "".join(out) + text[last:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in columns], names=columns)

    return docs.mapInArrow(run, docs.schema)
