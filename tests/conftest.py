import os

import pytest


def random_bytes(seed: int, size: int) -> bytes:
    """Bytes of a 64-bit linear congruential generator."""
    out, state = bytearray(), seed
    for _ in range(size):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append((state >> 33) & 255)
    return bytes(out)


def mesh_bytes() -> bytes:
    return b"".join((17 * i + 3).to_bytes(4, "little") for i in range(256))


@pytest.fixture
def tree(tmp_path):
    """Writes {path: bytes} below a fresh folder."""

    def write(files: dict[str, bytes], name: str = "in") -> str:
        root = tmp_path / name
        root.mkdir(exist_ok=True)
        for path, data in files.items():
            target = root / path
            os.makedirs(target.parent, exist_ok=True)
            target.write_bytes(data)
        return str(root)

    return write


@pytest.fixture
def made():
    return {"random": random_bytes, "mesh": mesh_bytes, "png": lambda: bytes.fromhex("89504E470D0A1A0A") + random_bytes(1, 256), "ogg": lambda: b"OggS" + random_bytes(2, 512)}
