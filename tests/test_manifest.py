"""Files of a folder, the sizes that images tell of themselves, and manifests against what is there."""

import hashlib
import struct

from tallyloom.sources import job_documents


def jpeg(width, height, marker=0xC0, comments=2):
    segment = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    return b"\xff\xd8" + b"".join(segment(0xE0 + i, b"x" * 300 * i) for i in range(comments)) + segment(marker, struct.pack(">BHH", 8, height, width) + b"\x03") + b"\xff\xda" + b"z" * 50


IMAGES = {
    "a/p.png": (b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"rest", ("png", 640, 480)), "a/g.gif": (b"GIF89a" + struct.pack("<HH", 320, 65535) + b"rest", ("gif", 320, 65535)),
    "j.jpg": (jpeg(1920, 1080), ("jpeg", 1920, 1080)), "b/progressive.jpg": (jpeg(7, 9, 0xC2, 10), ("jpeg", 7, 9)), "cut.jpg": (jpeg(5, 5)[:20], None), "tables.jpg": (jpeg(5, 5, 0xC4), None), "t.txt": (b"text", None), "short.png": (b"\x89PNG\r\n\x1a\n", None),
}


def test_files_and_image_sizes(spark, tmp_path):
    for name, (content, _) in IMAGES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty").write_bytes(b"")  # passed over
    got = {r["path"]: r for r in job_documents.files(spark, str(tmp_path)).collect()}
    assert {p: r["image"] and tuple(r["image"]) for p, r in got.items()} == {p: size for p, (_, size) in IMAGES.items()}
    assert all((r["sha256"], r["size_bytes"]) == (hashlib.sha256(IMAGES[p][0]).hexdigest(), len(IMAGES[p][0])) for p, r in got.items())


def test_every_difference_is_told_in_the_order_of_paths(spark):
    rows = lambda *x: spark.createDataFrame(x, "path string, sha256 string")
    out = job_documents.verified(rows(("b", "1"), ("a", "1"), ("c", "1"), ("/etc/x", "1"), ("x/../../y", "1"), (None, "1"), ("..a", "1")), rows(("a", "1"), ("b", "2"), ("d", "1"), ("..a", "1")))
    assert [tuple(r) for r in out.collect()] == [(None, "invalid path"), ("..a", None), ("/etc/x", "invalid path"), ("a", None), ("b", "checksum mismatch"), ("c", "missing"), ("d", "extra"), ("x/../../y", "invalid path")]
    assert job_documents.verified(spark.createDataFrame([], "path string, sha256 string"), rows(("a", "1"))).collect() == [("a", "extra")]
