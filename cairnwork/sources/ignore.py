"""Ignore rules as columns: patterns of control files, of which the last that matches a path or a folder above it decides."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern as a regular expression over a whole path (of a folder, with / at its end); keep takes a path back in."""

    expression: str
    keep: bool


def _glob(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := part.find("]", i + 2)) > 0:
            out += "[" + part[i + 1 : end].replace("!", "^", 1 if part[i + 1] == "!" else 0).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(part):
            out, i = out + re.escape(part[i + 1]), i + 1
        else:
            out += re.escape(c)
        i += 1
    return out


def rule(line: str, folder: str = "") -> Rule | None:
    """The rule of one line of a control file that lies in `folder`; none for blank lines and comments."""
    line = line.rstrip("\r\n")
    text = re.sub(r"(?<!\\) +$", "", line)
    if not text or text.startswith("#"):
        return None
    keep = text.startswith("!")
    text = text[1:] if keep else text
    folders_only = text.endswith("/")
    text = text.rstrip("/")
    rooted = "/" in text
    parts = [p for p in text.split("/") if p]
    if not parts:
        return None
    body = "".join(("(?:[^/]+/)*" if p == "**" and i < len(parts) - 1 else ".*" if p == "**" else _glob(p) + ("/" if i < len(parts) - 1 else "")) for i, p in enumerate(parts))
    base = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
    return Rule(f"^{base}{'' if rooted else '(?:[^/]+/)*'}{body}{'/' if folders_only else '/?'}$", keep)


def rules(files: DataFrame, name: str = ".gitignore") -> list[Rule]:
    """Rules of all control files of a tree (path, text), from the outside in; these are few, and go to the driver."""
    found = files.filter((F.col("path") == name) | F.col("path").endswith(f"/{name}")).select("path", "text").collect()
    out = []
    for r in sorted(found, key=lambda r: (r["path"].count("/"), r["path"])):
        folder = r["path"][: -len(name)]
        out += [x for line in (r["text"] or "").split("\n") if (x := rule(line, folder))]
    return out


def ignored(path: Column, found: list[Rule]) -> Column:
    """Whether the file, or a folder on the way to it, is ignored; what lies in an ignored folder can't be taken back."""
    parts = F.split(path, "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise("")))

    def decided(step: Column) -> Column:
        out = F.lit(False)
        for r in found:
            out = F.when(step.rlike(r.expression), F.lit(not r.keep)).otherwise(out)
        return out

    return F.exists(steps, decided)
