"""Where a repository lies, its head and its remotes, read by the driver from a few small files."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path


class NotARepository(Exception):
    """There is no repository at or above a folder."""


@dataclass(frozen=True)
class Repository:
    root: str
    git_dir: str
    common_dir: str
    branch: str
    head: str | None
    remotes: tuple[tuple[str, str], ...]

    @property
    def remote(self) -> tuple[str, str]:
        """The remote that names the repository: origin, else the first by name, else empty."""
        own = dict(self.remotes)
        name = "origin" if "origin" in own else min(own, default="")
        return name, own.get(name, "")


def _text(path: Path) -> str:
    return path.read_text(encoding="utf-8", errors="replace").strip() if path.is_file() else ""


def _resolved(git_dir: Path, common: Path, ref: str) -> str | None:
    """The commit that a reference names: a loose one first, then a packed one."""
    for folder in (git_dir, common):
        if found := _text(folder / ref):
            return found
    for line in _text(common / "packed-refs").splitlines():
        commit, _, name = line.partition(" ")
        if name == ref:
            return commit
    return None


def _remotes(config: str) -> tuple[tuple[str, str], ...]:
    """The first URL of each remote, by name."""
    found, name = {}, None
    for line in config.splitlines():
        if section := re.match(r"\s*\[(\w+)(?:\s+\"(.*)\")?\]", line):
            name = section[2] if section[1].lower() == "remote" else None
        elif name is not None and (url := re.match(r"\s*url\s*=\s*(.*\S)", line, re.IGNORECASE)):
            found.setdefault(name, url[1])
    return tuple(sorted(found.items()))


def discover(start: str) -> Repository:
    """The repository at or above ``start``. A worktree of its own points to its folder by a file; an unborn branch has no head."""
    here = Path(start).resolve()
    for root in (here, *here.parents):
        mark = root / ".git"
        if not mark.exists():
            continue
        git_dir = mark if mark.is_dir() else (root / _text(mark).removeprefix("gitdir:").strip()).resolve()
        shared = _text(git_dir / "commondir")
        common = (git_dir / shared).resolve() if shared else git_dir
        state = _text(git_dir / "HEAD")
        ref = state.removeprefix("ref:").strip() if state.startswith("ref:") else ""
        head = _resolved(git_dir, common, ref) if ref else state or None
        return Repository(str(root), str(git_dir), str(common), ref.removeprefix("refs/heads/"), head, _remotes(_text(common / "config")))
    raise NotARepository(start)
