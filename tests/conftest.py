import struct
import zlib

import pytest

from irisframe.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def png(path, pixels, channels=3):
    """Write rows of pixel tuples as an 8-bit PNG (gray, RGB or RGBA)."""
    height, width = len(pixels), len(pixels[0])
    kind = {1: 0, 3: 2, 4: 6}[channels]

    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    flat = b"".join(b"\0" + bytes(v for px in row for v in px) for row in pixels)
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(flat)) + chunk(b"IEND", b"")
    )
