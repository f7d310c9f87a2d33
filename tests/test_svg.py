import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspark.functions import svg
from helixspark.svg import convert, encode, raster

RED = b'<svg xmlns="http://www.w3.org/2000/svg" width="100" height="50"><rect width="100" height="50" fill="#ff0000"/></svg>'
GREEN = b'<svg width="20" height="20"><rect x="0" y="0" width="20" height="20" fill="#00ff00"/></svg>'
CM = b"<svg width='10cm' height='5cm'><rect width='10' height='10'/></svg>"


def pixels_of(png):
    w, h = struct.unpack(">II", png[16:24])
    at = png.index(b"IDAT") - 4
    n = struct.unpack(">I", png[at : at + 4])[0]
    rows = np.frombuffer(zlib.decompress(png[at + 8 : at + 8 + n]), np.uint8).reshape(h, w * 4 + 1)
    return rows[:, 1:].reshape(h, w, 4)


def test_lengths(spark):
    cases = {"100": (100, "", 100 / 96), "10cm": (377.952755905, "cm", 10 / 2.54), "3.5in": (336, "in", 3.5), "72pt": (96, "pt", 1), "25.4mm": (96, "mm", 1), "": None, "abc": None, "10em": None, "100%": (100, "%", 100 / 96), " 8PC ": (128, "pc", 8 / 6), "1.2.3": None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", svg.parse_length(F.col("s")).alias("x")).collect()
    for r in rows:
        want = cases[r["s"]]
        assert (r["x"] is None) == (want is None)
        if want:
            assert r["x"]["px"] == pytest.approx(want[0]) and r["x"]["unit"] == want[1] and r["x"]["inches"] == pytest.approx(want[2])


def test_colours_and_tags(spark):
    rows = spark.createDataFrame([("#fff",), ("#FF8800",), ("##80FF0000",), ("#12",), ("xyz",)], "s string").select(svg.parse_hex_color(F.col("s")).alias("c")).collect()
    assert [tuple(r["c"]) if r["c"] else None for r in rows] == [(255, 255, 255, 255), (255, 136, 0, 255), (255, 0, 0, 128), None, None]
    rows = spark.createDataFrame([('<x/><SVG width="10cm" height="5cm">',), ("<svg width='100' height='200'/>",), ("<html>",), ("<svg",)], "s string").select(svg.extract_svg_size(F.col("s")).alias("c")).collect()
    assert [tuple(r["c"]) for r in rows] == [("10cm", "5cm"), ("100", "200"), (None, None), (None, None)]


@pytest.mark.parametrize(("options", "want"), [({}, (200, 100)), ({"width": 400, "height": 200}, (400, 200)), ({"scale": 2.0}, (400, 200)), ({"keep_physical": True, "dpi": 300.0}, (1181, 591)), ({"width": 400}, (400, 200)), ({"height": 50, "scale": 3.0}, (100, 50)), ({"scale": 1e6}, (65535, 65535))])
def test_target_sizes(spark, options, want):
    inches = (10 / 2.54, 5 / 2.54)
    assert convert.sizes(200.0, 100.0, convert.Options(**options), inches)[:2] == want
    o = {"width": None, "height": None, "scale": 1.0, "keep_physical": False, "dpi": 96.0} | options
    args = [F.lit(v) for v in (200.0, 100.0, o["width"], o["height"], o["scale"], o["keep_physical"], o["dpi"], *inches)]
    row = spark.range(1).select(svg.target_size(*args).alias("x")).first()["x"]
    assert (row["w"], row["h"]) == want


def test_conversion_of_documents(spark):
    docs = spark.createDataFrame([("red", bytearray(RED)), ("cm", bytearray(CM)), ("bad", bytearray(b"<svg")), ("none", None)], "path string, content binary")
    rows = {r["path"]: r for r in convert.convert_svgs(docs).collect()}
    image = bytes(rows["red"]["image"])
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and b"pHYs" in image and rows["red"]["bytes_written"] == len(image)
    assert (pixels_of(image) == (255, 0, 0, 255)).all() and pixels_of(image).shape == (50, 100, 4)
    assert not rows["bad"]["ok"] and rows["bad"]["error"] and not rows["none"]["ok"]
    info = {r["path"]: r for r in convert.svg_info(docs).collect()}
    assert info["cm"]["width"] == pytest.approx(377.9527559) and info["cm"]["width_unit"] == "10cm" and info["cm"]["physical_height_in"] == pytest.approx(5 / 2.54)
    assert info["red"]["physical_width_in"] == pytest.approx(100 / 96) and not info["bad"]["ok"]
    webp = convert.convert_svgs(docs.where("path = 'red'"), convert.Options(format="webp")).first()
    assert not webp["ok"] and "webp" in webp["error"]


def test_shapes_styles_and_clips():
    doc = b"""<svg width="40" height="40"><style>.a { fill: #0000ff; opacity: 0.5 } .b, .c { display: none }</style>
    <defs><clipPath id="k"><rect x="0" y="0" width="10" height="40"/></clipPath></defs>
    <g transform="translate(20 0) scale(2)"><rect class="a" width="5" height="5"/><rect class="b" width="20" height="20"/></g>
    <circle cx="10" cy="30" r="6" fill="red"/><path d="M 30 30 h 5 v 5 h -5 z" style="fill:rgb(0,255,0)"/>
    <rect x="0" y="12" width="40" height="4" clip-path="url(#k)"/><line x1="0" y1="20" x2="40" y2="20" stroke="black" stroke-width="2"/></svg>"""
    for scale in (1, 2):
        p = raster.render(doc, 40 * scale, 40 * scale, scale, scale, (255, 255, 255, 255))
        at = lambda x, y: tuple(int(v) for v in p[y * scale, x * scale, :3])
        assert at(22, 2) in {(128, 128, 255), (127, 127, 255)} and at(35, 2) == (255, 255, 255)
        assert at(10, 30) == (255, 0, 0) and at(17, 30) == (255, 255, 255) and at(32, 32) == (0, 255, 0)
        assert at(5, 13) == (0, 0, 0) and at(15, 13) == (255, 255, 255) and at(20, 20) == (0, 0, 0)
    with pytest.raises(ValueError):
        raster.path_lines("M 0 0 L 1 1 Z 5 5")
    with pytest.raises(ValueError):
        raster.path_lines("M 0 0 C 1 1")
    (curve, closed), = raster.path_lines("m 1 1 c 0 10 10 10 10 0 s 10 -10 10 0")
    assert not closed and tuple(curve[-1]) == (21.0, 1.0)


def test_encoders():
    p = raster.render(GREEN, 20, 20, 1, 1, (255, 255, 255, 255))
    assert zlib.crc32(b"123456789") == 0xCBF43926
    assert (pixels_of(encode.encode(p, "png", dpi=300)) == p).all()
    image = encode.encode(p, "bmp")
    assert image[:2] == b"BM" and len(image) == 54 + 20 * 60 and image[54:57] == b"\0\xff\0"
    assert encode.encode(p, "tiff")[:4] == b"II*\0" and encode.encode(p, "tiff").endswith(p.tobytes())
    doc = encode.encode(p, "PDF", dpi=72)
    assert doc.startswith(b"%PDF-") and b"[0 0 20.0000 20.0000]" in doc and doc.count(b" obj\n") == 5
    photo = encode.encode(p, "jpg", quality=200)
    assert photo[:2] == b"\xff\xd8" and photo[-2:] == b"\xff\xd9"
    half = np.array([[[128, 0, 0, 128], [9, 9, 9, 0]]], np.uint8)
    assert encode.unpremultiply(half).tolist() == [[[255, 0, 0, 128], [0, 0, 0, 0]]]
    assert encode.flatten(encode.unpremultiply(half)).tolist() == [[[255, 127, 127], [255, 255, 255]]]
    with pytest.raises(ValueError, match="webp"):
        encode.encode(p, "webp")


def test_files_and_default_size(spark, tmp_path):
    (tmp_path / "a.svg").write_bytes(RED)
    (tmp_path / "b.svg").write_bytes(b"<svg><rect width='10' height='10'/></svg>")
    docs = convert.read_svgs(spark, str(tmp_path / "*.svg"))
    assert convert.write_images(convert.convert_svgs(docs), str(tmp_path / "out")) == 1
    assert (pixels_of((tmp_path / "out" / "a.png").read_bytes()) == (255, 0, 0, 255)).all()
    sizes = {r["path"][-5:]: (r["width"], r["height"]) for r in convert.convert_svgs(docs, convert.FAST).collect()}
    assert sizes == {"a.svg": (100, 50), "b.svg": (800, 600)}


@pytest.mark.parametrize("kind", ["png", "jpeg", "tiff", "bmp", "pdf"])
def test_one_partition_is_drawn_by_all_cores(spark, kind):
    docs = spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("path"), F.encode(F.concat(F.lit('<svg width="4" height="'), F.col("id") + 1, F.lit('"/>')), "UTF-8").alias("content"))
    found = convert.convert_svgs(docs, convert.Options(format=kind))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows = found.select("path", "ok", "width", "height", F.length("image").alias("n"), "bytes_written").collect()
    assert sorted((int(r["path"]), r["width"], r["height"]) for r in rows) == [(k, 4, k + 1) for k in range(40)]
    assert all(r["ok"] and r["n"] == r["bytes_written"] for r in rows)


def test_coverage_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    polygons = [rng.uniform(-9, 30, (n, 2)) for n in (3, 4, 50)]
    first, whole = raster.coverage(polygons, 20, 17)
    for samples in (1, 64, 1000):
        monkeypatch.setattr(raster, "_SAMPLES", samples)
        again = raster.coverage(polygons, 20, 17)
        assert again[0] == first and (again[1] == whole).all()
    wide = b'<svg width="4" height="4"><polygon points="0,0 1e300,0 1e300,4 0,4" fill="#ff0000"/></svg>'
    assert (raster.render(wide, 4, 4, 1, 1, (255, 255, 255, 255)) == (255, 0, 0, 255)).all()


def _zigzag_cells(photo, blocks):
    """Values of a JPEG's entropy-coded segment, read code by code."""
    at = photo.index(b"\xff\xda") + 14
    bits = "".join(f"{x:08b}" for x in photo[at:-2].replace(b"\xff\0", b"\xff"))
    tables = []
    for lengths, symbols in ((encode._DC_LENGTHS, encode._DC_SYMBOLS), encode._even_codes()):
        table, code, k = {}, 0, 0
        for n, amount in enumerate(lengths, 1):
            for s in symbols[k : k + amount]:
                table[f"{code:0{n}b}"] = s
                code += 1
            k, code = k + amount, code << 1
        tables.append(table)
    place = 0

    def symbol(table):
        nonlocal place
        n = next(n for n in range(1, 17) if bits[place : place + n] in table)
        place += n
        return table[bits[place - n : place]]

    def number(size):
        nonlocal place
        text = bits[place : place + size]
        place += size
        return 0 if not size else int(text, 2) if text[0] == "1" else int(text, 2) - (1 << size) + 1

    out, last = np.zeros((blocks, 3, 64), int), [0, 0, 0]
    for n in range(blocks):
        for c in range(3):
            last[c] += number(symbol(tables[0]))
            out[n, c, 0], k = last[c], 1
            while k < 64:
                s = symbol(tables[1])
                if s == 0:
                    break
                k += s >> 4
                if s != 0xF0:
                    out[n, c, k] = number(s & 15)
                k += 1
    assert len(bits) - place < 8 and set(bits[place:]) <= {"1"}
    return out


def test_jpeg_codes(monkeypatch):
    rng = np.random.default_rng(4)
    blocks = rng.integers(-900, 900, (7, 3, 64)) * (rng.random((7, 3, 64)) < rng.choice([0.0, 0.02, 0.1, 1.0], (7, 3, 1)))
    codes = encode._entropy(blocks)
    assert (_zigzag_cells(b"\xff\xda" + bytes(12) + codes + b"\xff\xd9", 7) == blocks).all()
    monkeypatch.setattr(encode, "_WORDS", 5)
    assert encode._entropy(blocks) == codes
