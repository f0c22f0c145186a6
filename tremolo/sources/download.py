"""Files from the network, kept in a folder; whole or not at all."""

from __future__ import annotations

import os
import shutil
import uuid
from urllib.request import Request, urlopen

#: Recordings are larger than this; smaller files are errors (a fixed value).
LEAST_BYTES = 100 * 1024


def fetch(url: str, target: str, least: int = LEAST_BYTES, force: bool = False, tries: int = 2, timeout: float = 60.0) -> str:
    """Brings a file to ``target``: "cached" if one of more than ``least`` bytes is there, else "downloaded".

    It is written beside its place and moved there once it is whole. What fails or is too small is tried
    again, ``tries`` times in all, and leaves nothing behind. Runs on the driver: for a handful of files.
    """
    if not force and os.path.isfile(target) and os.path.getsize(target) > least:
        return "cached"
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    for k in range(tries):
        part = f"{target}.{uuid.uuid4().hex[:8]}.part"
        try:
            with urlopen(Request(url, headers={"User-Agent": "tremolo"}), timeout=timeout) as source, open(part, "wb") as out:
                shutil.copyfileobj(source, out, 1 << 18)
            if os.path.getsize(part) <= least:
                raise OSError(f"{url}: {os.path.getsize(part)} bytes are too few")
            os.replace(part, target)
            return "downloaded"
        except OSError:
            if k == tries - 1:
                raise
        finally:
            if os.path.exists(part):
                os.remove(part)
    raise ValueError("tries must be 1 at least")
