import numpy as np

from pagemill.sources import images as M


def test_first_images(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(bytes([2, 3]) + bytes(range(18)))
    (tmp_path / "img" / "b.png").write_bytes(b"broken")
    rows = spark.createDataFrame([(1, ["img/a.png", "img/b.png"]), (2, ["img/b.png"]), (3, ["img/none.png"]), (4, []), (5, None)], "k int, images array<string>")
    joined = M.with_first_image(rows, M.read_images(spark, str(tmp_path)), str(tmp_path))
    assert sorted(r.k for r in joined.collect()) == [1, 2]

    def codec(data):
        return np.frombuffer(data[2:], np.uint8).reshape(data[0], data[1], 3)

    (only,) = M.decoded_images(joined, codec, "k").collect()
    assert (only.key, only.height, only.width, bytes(only.pixels)) == (1, 2, 3, bytes(range(18)))
