"""A numbered copy of a submission, with what identifies it."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import shutil
from pathlib import Path

HEAD = "| n | time | label | params | sha256 | estimate | notes |\n|-|-|-|-|-|-|-|\n"


def snapshot(source: str, root: str, label: str, params: str, estimate: str = "n/a", notes: str = "", version: str = "") -> Path:
    """Copies the file into ``root``/<number>_<label>, writes meta.json beside it and a row to ``root``/LOG.md. Numbers go on from the log."""
    base, log = Path(root), Path(root) / "LOG.md"
    base.mkdir(parents=True, exist_ok=True)
    rows = log.read_text().splitlines() if log.exists() else []
    number = 1 + sum(bool(re.match(r"\| \d+ \|", r)) for r in rows)
    digest = hashlib.sha256()
    with open(source, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    folder = base / f"{number:02d}_{re.sub('[^a-z0-9]+', '-', label.lower()).strip('-')}"
    folder.mkdir()
    shutil.copy(source, folder / Path(source).name)
    now = datetime.datetime.now().strftime("%Y-%m-%d %H:%M")
    meta = {"n": number, "time": now, "label": label, "params": params, "version": version, "sha256": digest.hexdigest(), "estimate": estimate, "notes": notes}
    (folder / "meta.json").write_text(json.dumps(meta, indent=2))
    with open(log, "a") as f:
        f.write(("" if rows else HEAD) + f"| {number} | {now} | {label} | {params} | {meta['sha256'][:12]} | {estimate} | {notes} |\n")
    return folder
