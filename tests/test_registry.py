"""Conversions of folders with broken and foreign files."""

import pytest

from rasterflow.sources import media, registry

SCHEMA = "media_id string, format string, content binary"


def test_broken_files_give_typed_errors(spark, tmp_path):
    image = (2, 3, bytes(range(20)) + b"\xff" * 4)
    for fmt, encode in media.ENCODERS.items():
        (tmp_path / f"good.{fmt}").write_bytes(encode(*image))
        (tmp_path / f"cut.{fmt}").write_bytes(encode(*image)[:40])
    (tmp_path / "wrong.png").write_bytes(b"GIF89a")
    (tmp_path / "text.txt").write_bytes(b"hello")
    done = {r.media_id.rsplit("/", 1)[1]: r for r in registry.convert(media.read_media(spark, str(tmp_path)), "bmp").collect()}
    assert {n for n, r in done.items() if r.success} == {f"good.{f}" for f in media.ENCODERS}
    assert all(media.decode_bmp(bytes(r.content)) == image and r.error is None for r in done.values() if r.success)
    kinds = {n: r.error_kind for n, r in done.items() if not r.success}
    assert kinds == {f"cut.{f}": registry.BROKEN for f in media.ENCODERS} | {"wrong.png": registry.NO_DECODER, "text.txt": registry.UNKNOWN}
    assert all(r.error and r.content is None and r.format is None for r in done.values() if not r.success)


def test_formats_without_encoder_and_nulls(spark):
    pgm = b"P5 2 1 255 \x01\x02"
    files = spark.createDataFrame([("a", "pgm", pgm), ("b", "pgm", None), ("c", None, pgm), ("d", "nonsense", b"")], SCHEMA)
    assert {r.media_id: r.error_kind for r in registry.convert(files, "pgm").collect()} == {"a": registry.NO_ENCODER, "b": registry.BROKEN, "c": registry.UNKNOWN, "d": registry.NO_DECODER}
    info = {r.media_id: (r.success, r.width, r.height, r.opaque, r.length) for r in registry.show_info(files).collect()}
    assert info["a"] == (True, 2, 1, True, len(pgm)) and info["b"] == (False, None, None, None, None)
    assert registry.convert(files.limit(0), "bmp").count() == 0 and ("png", True, True) in registry.capabilities()


@pytest.mark.parametrize("fmt", sorted(media.DECODERS))
def test_no_prefix_of_a_file_stops_a_job(fmt):
    raw = media.ENCODERS.get(fmt, lambda *_: b"P6 2 1 255 " + bytes(6))(2, 1, bytes(range(8)))
    for cut in range(len(raw)):
        try:
            width, height, data = registry._opened(fmt, raw[:cut])
            assert len(data) == width * height * 4
        except registry._Failed as failed:
            assert failed.kind == registry.BROKEN
