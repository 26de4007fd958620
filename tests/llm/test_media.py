import hashlib
import io
import zlib

import numpy as np
import pytest

from gridloom.llm import media
from tests.llm.helpers import clashing, empty, frame, odd_rows


def test_formats_round_trip():
    rng = np.random.default_rng(0)
    for height, width in ((1, 1), (3, 5), (7, 64), (8, 2)):
        image = rng.integers(0, 256, (height, width, 3), dtype=np.uint8)
        assert (media.decode(media.encode_ppm(image)) == image).all()
        assert (media.decode(media.encode_bmp(image)) == image).all()


def test_other_netpbm_kinds():
    grey = media.decode(b"P5\n# note\n2 2\n255\n\x00\x01\x02\x0a")
    assert grey.tolist() == [[0, 1], [2, 10]]
    assert media.decode(b"P2\n2 1\n255\n7 9").tolist() == [[7, 9]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P1\n3 1\n1 0 1\n").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n9 1\n\x80\x80").tolist() == [[0, *[255] * 7, 0]]
    for bad in (b"P7\n", b"P6\n1 1\n65535\n", b"P5\n2", b"xx"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_bmp_top_down_and_palette():
    bottom_up = bytearray(media.encode_bmp(np.arange(12, dtype=np.uint8).reshape(2, 2, 3)))
    body, head = bytes(bottom_up[54:]), bytearray(bottom_up[:54])
    head[22:26] = (-2).to_bytes(4, "little", signed=True)
    assert media.decode(bytes(head) + body[8:] + body[:8]).tolist() == np.arange(12).reshape(2, 2, 3).tolist()


def test_area_resize_is_the_mean_under_each_cell():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (10, 12), dtype=np.uint8)
    fine = np.kron(image, np.ones((4, 3)))  # 40 x 36: divides into 8 x 9 cells of 5 x 4
    want = fine.reshape(8, 5, 9, 4).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 8, 9), want)
    tall = rng.integers(0, 256, (5000, 9), dtype=np.uint8)
    assert np.allclose(media.area_resize(tall, 8, 9), tall.reshape(8, 625, 9).mean(axis=1))


def test_columns_match_brute_force(spark):
    rows = odd_rows()
    found = media.read(media.store(clashing(frame(spark, rows)))).collect()
    want = []
    for i, text, *_ in rows:
        data = (text or "").encode()
        full = data + b" " * (-len(data) % 192 or (192 if not data else 0))
        want.append((i, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert sorted([(r["id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found], key=str) == sorted(want, key=str)
    for r in found:
        image = media.decode(bytes(r["media"]))
        assert hashlib.sha256(image.tobytes()).hexdigest() == r["payload_sha256"]
        tile = np.load(io.BytesIO(bytes(r["tile"])))
        assert tile.shape == media.TILE and media.difference_hash(tile) == r["difference_hash"]


def test_empty_table(spark):
    assert media.read(media.store(empty(spark))).count() == 0
