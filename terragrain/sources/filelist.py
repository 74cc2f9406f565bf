"""Names of input files: lists, patterns, environment variables, folders."""

from __future__ import annotations

import glob
import os
import re

from ..operators.blocks import divide_tasks


def read_file_list(path: str) -> list[str]:
    """One path per line; trailing white space goes, and so do empty lines."""
    with open(path) as f:
        return [x for x in (line.rstrip() for line in f) if x]


def expand_env(text: str) -> str:
    """${NAME} becomes the variable's value, or nothing if it is unset."""
    return re.sub(r"\$\{([^}]+)\}", lambda m: os.environ.get(m[1], ""), text)


def expand_paths(patterns: list[str]) -> list[str]:
    """Patterns with variables and wildcards to sorted paths; a pattern that matches nothing raises."""
    out = []
    for p in map(expand_env, patterns):
        found = sorted(glob.glob(p)) if glob.has_magic(p) else [p]
        if not found:
            raise FileNotFoundError(p)
        out += found
    return out


def list_files(folder: str, extension: str, start: int = 0, end: int | None = None) -> list[str]:
    """Files of a folder by extension, not below it, sorted; the slice [start, end)."""
    ext = extension if extension.startswith(".") else f".{extension}"
    return [os.path.join(folder, n) for n in sorted(os.listdir(folder)) if n.endswith(ext)][start:end]


def share_files(paths: list[str], procs: int) -> list[list[str]]:
    """Contiguous shares for ``procs`` processes; the first ones get one more where it does not divide."""
    return [[paths[k] for k in r] for r in divide_tasks(len(paths), procs)]
