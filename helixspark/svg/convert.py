"""SVG metadata and conversion over tables of documents (``path, content``)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.svg import UNIT_PX, extract_svg_size, parse_length
from ..session import spread
from . import encode, raster


@dataclass(frozen=True)
class Options:
    format: str = "png"
    scale: float = 1.0
    width: int = 0
    height: int = 0
    quality: int = 92
    dpi: float = 96.0
    keep_physical: bool = False
    background: str | None = None
    default_size: tuple[float, float] | None = None


#: For documents without a size: what the streaming conversion assumes.
FAST = Options(default_size=(800.0, 600.0))


def background_of(text: str | None) -> tuple[int, int, int, int]:
    """Red, green, blue, alpha; opaque white where nothing valid is given."""
    h = (text or "").strip().lstrip("#")
    try:
        if len(h) == 3:
            return (*(int(c * 2, 16) for c in h), 255)
        if len(h) == 6:
            return (*(int(h[k : k + 2], 16) for k in (0, 2, 4)), 255)
        if len(h) == 8:
            return (*(int(h[k : k + 2], 16) for k in (2, 4, 6)), int(h[:2], 16))
    except ValueError:
        pass
    return 255, 255, 255, 255


def _half_up(x: float) -> int:
    return int(x + 0.5)


def sizes(w: float, h: float, o: Options, inches: tuple[float, float]) -> tuple[int, int, float, float]:
    if o.width > 0 or o.height > 0:
        sx = o.width / w if o.width > 0 else o.height / h
        sy = o.height / h if o.height > 0 else sx
        out = o.width or _half_up(w * sx), o.height or _half_up(h * sy)
    elif o.keep_physical and min(inches) > 0:
        out = _half_up(inches[0] * o.dpi), _half_up(inches[1] * o.dpi)
        sx, sy = out[0] / w, out[1] / h
    else:
        sx = sy = o.scale if abs(o.scale - 1) > 1e-9 else 1.0
        out = _half_up(w * sx), _half_up(h * sy)
    return min(max(out[0], 1), 65535), min(max(out[1], 1), 65535), sx, sy


def convert_bytes(content: bytes, options: Options = Options()) -> tuple[bytes, int, int]:
    """Encoded image, width and height; raises what is wrong."""
    head = raster.head_of(content, options.default_size)
    w, h = head.width, head.height

    def inches(name: str, px: float) -> float:
        text = (head.root.get(name) or "").strip()
        m = raster.NUMBER.match(text)
        unit = text[m.end() :].strip().lower() if m else ""
        return float(m.group()) * UNIT_PX.get(unit, 1.0) / 96 if m else px / 96

    width, height, sx, sy = sizes(w, h, options, (inches("width", w), inches("height", h)))
    pixels = raster.render(content, width, height, sx, sy, background_of(options.background), head)
    return encode.encode(pixels, options.format, options.quality, options.dpi), width, height


def read_svgs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


_SCHEMA = "path string, ok boolean, width int, height int, bytes_written long, format string, dpi double, error string, image binary"
_ARROW = pa.schema([("path", pa.string()), ("ok", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("bytes_written", pa.int64()), ("format", pa.string()), ("dpi", pa.float64()), ("error", pa.string()), ("image", pa.binary())])
#: A batch of results ends with the row that reaches one of these.
_ROWS, _BYTES = 1000, 8_000_000


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def convert_svgs(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """``path, ok, width, height, bytes_written, format, dpi, error, image``; what fails is told in its row.

    Drawing takes far longer than reading, so a table of few partitions is dealt to all cores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                try:
                    image, w, h = convert_bytes(content.as_py() or b"", options)
                    row = (True, w, h, len(image), None, image)
                except Exception as e:
                    row = (False, 0, 0, 0, str(e) or type(e).__name__, None)
                rows.append((path.as_py(), *row[:4], options.format, float(options.dpi), *row[4:]))
                held += row[3]
                if len(rows) >= _ROWS or held >= _BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    return spread(docs.select("path", "content")).mapInArrow(run, _SCHEMA)


def write_images(images: DataFrame, folder: str, names: str = "path") -> int:
    """Writes the images of ``convert_svgs`` as files into ``folder`` of any file system; how many.

    Rows come to the driver one partition at a time. For many images, write the
    table itself instead.
    """
    from ..vector.store import Files

    files, n = Files(images.sparkSession), 0
    for row in images.where("ok").select(names, "format", "image").toLocalIterator():
        stem = row[names].rstrip("/").rpartition("/")[2].removesuffix(".svg")
        files.write(f"{folder.rstrip('/')}/{stem}.{row['format']}", bytes(row["image"]))
        n += 1
    return n


def svg_info(docs: DataFrame) -> DataFrame:
    """``path, ok, width, height, width_unit, height_unit, physical_width_in, physical_height_in, error``.

    Sizes in pixels come from the parsed document, units and inches from the
    raw text; without a raw size the unit is px and inches are pixels / 96.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column("content"):
                try:
                    head = raster.head_of(content.as_py() or b"")
                    rows.append((head.width, head.height, None))
                except Exception as e:
                    rows.append((0.0, 0.0, str(e) or type(e).__name__))
            w, h, error = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "raw": batch.column("raw"), "w": pa.array(w, pa.float64()), "h": pa.array(h, pa.float64()), "error": pa.array(error, pa.string())})

    raw = extract_svg_size(F.decode("content", "UTF-8"))
    parsed = docs.select("path", "content", raw.alias("raw")).mapInArrow(run, "path string, raw struct<width:string,height:string>, w double, h double, error string")
    ok = F.col("error").isNull()
    x, y = parse_length(F.col("raw.width")), parse_length(F.col("raw.height"))

    def unit(v, raw_text):
        return F.when(ok, F.when(v.isNotNull(), raw_text).otherwise("px")).otherwise("")

    def inches(v, px):
        return F.when(ok, F.coalesce(v["inches"], px / 96)).otherwise(F.lit(0.0))

    return parsed.select("path", ok.alias("ok"), F.col("w").alias("width"), F.col("h").alias("height"), unit(x, F.col("raw.width")).alias("width_unit"), unit(y, F.col("raw.height")).alias("height_unit"), inches(x, F.col("w")).alias("physical_width_in"), inches(y, F.col("h")).alias("physical_height_in"), "error")
