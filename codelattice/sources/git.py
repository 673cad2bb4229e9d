"""What git knows about a source tree."""

from __future__ import annotations

import subprocess


def _git(root: str, *args: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)


def head(root: str) -> str | None:
    """The current commit, null outside a repository or without git."""
    try:
        got = _git(root, "rev-parse", "HEAD")
    except OSError:
        return None
    return got.stdout.strip() or None if got.returncode == 0 else None


def changed_files(root: str, base: str) -> list[str]:
    """Paths that differ from a base; what git says against it becomes the error."""
    got = _git(root, "diff", "--name-only", base, "--")
    if got.returncode:
        raise RuntimeError(f"nothing to compare with {base}: {got.stderr.strip()}")
    return [p for line in got.stdout.splitlines() if (p := line.strip().replace("\\", "/"))]
