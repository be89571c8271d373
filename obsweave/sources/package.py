"""A run's results as one package, and what a release must satisfy."""
from __future__ import annotations

import io
import zipfile

LIMIT = 1_500_000  # bytes of a chart script


def pack(files: dict[str, bytes], limit: int = LIMIT) -> bytes:
    """A ZIP with the files in order of name, deflated as far as possible; its checksums are read back. A script (*.js) above `limit` bytes is refused."""
    for name, data in files.items():
        if name.endswith(".js") and len(data) > limit:
            raise ValueError(f"{name} has {len(data)} bytes, more than {limit}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), files[name], zipfile.ZIP_DEFLATED, 9)
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        if (bad := z.testzip()) is not None:
            raise ValueError(f"{bad} does not read back")
    return out.getvalue()


def missing(package: bytes, required: list[str]) -> list[str]:
    """Required files that a package lacks or that are empty."""
    with zipfile.ZipFile(io.BytesIO(package)) as z:
        sizes = {i.filename: i.file_size for i in z.infolist()}
    return [name for name in required if not sizes.get(name)]
