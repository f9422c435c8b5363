"""Sections of Markdown, reStructuredText and MDX files, by heading, with line numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .files import DOC_NAMES

SCHEMA = "package string, file string, line int, name string, doc string, parents array<int>, imports array<string>"
#: Bytes at which a section is split: beyond SOFT at a blank line once a part has LEAST, beyond HARD anywhere.
LEAST, SOFT, HARD = 1200, 1800, 5400
_ATX = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"^\s*(```+|~~~+)\s*(\S*)")
_RULE = re.compile(r"^([=\-~^\"'`*+#.:_])\1{2,}\s*$")
_HTML = re.compile(r"<h([1-6])[^>]*>(.*?)</h\1>", re.I | re.S)
_BADGE = re.compile(r"^\s*(\[?!\[[^\]]*\]\([^)]*\)\]?(\([^)]*\))?\s*)+$|^\s*</?(p|div|br|a|img|center|picture|source)\b[^>]*>\s*$", re.I)
_IMPORT = re.compile(r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)['"]([^'"./][^'"]*)['"]""")


def fence_of(line: str) -> re.Match | None:
    """``_FENCE``, for which few lines need to be matched."""
    return _FENCE.match(line) if "```" in line or "~~~" in line else None


def is_badge(line: str) -> bool:
    return line.lstrip()[:1] in ("[", "!", "<") and _BADGE.match(line) is not None


def clean_heading(text: str) -> str:
    """Without MDX ids, link targets, code ticks and tags."""
    text = re.sub(r"\s*\{#[^}]*\}\s*$", "", text)
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return " ".join(re.sub(r"<[^>]*>", "", text).replace("`", "").split())


def clean_mdx(text: str) -> tuple[str, str | None]:
    """Front matter, imports, exports and lines of JSX only become blank lines; the title is returned beside the text."""
    title, lines = None, text.split("\n")
    if lines and lines[0].strip() == "---" and (end := next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)):
        found = dict(re.findall(r"^(title|description):\s*[\"']?(.*?)[\"']?\s*$", "\n".join(lines[1:end]), re.M))
        title = found.get("title")
        lines[: end + 1] = [found.get("description", ""), *[""] * end]
    fence = None
    for i, line in enumerate(lines):
        if m := fence_of(line):
            fence = None if fence and m[1].startswith(fence) else fence or m[1]
        elif not fence and line[:1] in ("i", "e", "<") and re.match(r"^(import\s.*from\s|import\s+['\"]|export\s|</?[A-Z][^>]*>\s*$)", line):
            lines[i] = ""
    return "\n".join(lines), title


def imports_of(code: str) -> dict[str, str]:
    """Packages that code imports, with the import path: of ``@a/b/c``, ``@a/b``."""
    out = {}
    for path in _IMPORT.findall(code):
        out["/".join(path.split("/")[: 2 if path.startswith("@") else 1])] = path
    return out


def split(text: str, title: str, markdown: bool = True) -> list[tuple[int, str, str, list[int], list[str]]]:
    """Sections as (line, heading path, text, lines of the headings above, effective imports); text before headings first."""
    lines = text.split("\n")
    sections: list[dict] = [{"line": 1, "level": 0, "head": [title], "body": [], "parents": [], "own": {}, "up": None}]
    stack, levels = [0], {}
    fence, code, i = None, None, 0
    while i < len(lines):
        line, level, head, skip = lines[i], None, "", 1
        if m := fence_of(line):
            if fence is None:
                fence, code = m[1][:3], [] if m[2].lower() in ("js", "jsx", "ts", "tsx", "javascript", "typescript") else None
            elif line.strip().startswith(fence):
                if code is not None:
                    sections[-1]["own"].update(imports_of("\n".join(code)))
                fence = code = None
        elif fence:
            if code is not None:
                code.append(line)
        elif markdown and "#" in line and (m := _ATX.match(line)):
            level, head = len(m[1]), m[2]
        elif markdown and line.lstrip()[:2].lower() == "<h" and (m := _HTML.search("\n".join(lines[i : i + 4]))):
            level, head, skip = int(m[1]), m[2], 1 + "\n".join(lines[i : i + 4])[: m.end()].count("\n")
        elif line.strip() and not line.startswith((" ", "\t")) and i + 1 < len(lines) and (r := _RULE.match(lines[i + 1])) and len(line.encode()) <= 120:
            mark, long_enough = r[1], len(lines[i + 1].strip()) >= len(line.strip()) - 2
            if long_enough and (not markdown or mark in "=-"):
                level, head, skip = ({"=": 1, "-": 2}[mark] if markdown else levels.setdefault(mark, len(levels) + 1)), line, 2
        if level is None:
            if fence or not is_badge(line):
                sections[-1]["body"].append((i + 1, line))
            i += 1
            continue
        while len(stack) > 1 and sections[stack[-1]]["level"] >= level:
            stack.pop()
        up = sections[stack[-1]]
        above = [sections[k]["line"] for k in stack if any(b.strip() for _, b in sections[k]["body"])]
        sections.append({"line": i + 1, "level": level, "head": [*up["head"], clean_heading(head)], "body": [], "parents": above, "own": {}, "up": stack[-1]})
        stack.append(len(sections) - 1)
        i += skip
    out = []
    for s in sections:
        s["all"] = {**(sections[s["up"]]["all"] if s["up"] is not None else {}), **s["own"]}
        for k, (line, part) in enumerate(chunks(s["body"])):
            out.append((line if k else s["line"], " › ".join(h for h in s["head"] if h), part, s["parents"], sorted(s["all"].values())))
    return out


def chunks(body: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Parts of a section's numbered lines, each with the number of its first line: a long one is split at blank lines outside code."""
    whole = sum(len(line.encode()) + 1 for _, line in body) <= SOFT
    parts, own, size, fence = [], [], 0, False
    for n, line in body:
        fence ^= fence_of(line) is not None
        if own and not whole and ((not line.strip() and not fence and size > LEAST) or size + len(line.encode()) > HARD):
            parts.append(own)
            own, size = [], 0
        if own or line.strip():
            own.append((n, line))
            size += len(line.encode()) + 1
    return [(p[0][0], "\n".join(line for _, line in p).rstrip("\n")) for p in [*parts, own] if p]


def title_of(file: str, metadata: bool) -> str:
    """What a file without a title is called: a page from upstream by its words, any other by its name."""
    base = file.rpartition("/")[2]
    if metadata:
        return "README"
    if not file.startswith("upstream:") or base.upper().startswith(DOC_NAMES):
        return base
    return re.sub(r"[_-]", " ", re.sub(r"^[\d-]+", "", base.rpartition(".")[0] or base))


def sections(files: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` from prose files (``package, file, how, text``)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for package, file, how, text in zip(frame.package, frame.file, frame.how, frame.text, strict=True):
                skip, title = 0, None
                if how == "metadata":
                    head, _, text = (text or "").partition("\n\n")
                    skip = head.count("\n") + 2
                elif file.endswith((".mdx", ".md")):
                    text, title = clean_mdx(text or "")
                for line, name, doc, parents, imports in split(text or "", title or title_of(file, how == "metadata"), not file.endswith((".rst", ".txt"))):
                    rows.append((package, file, line + skip, name, doc, [p + skip for p in parents], imports))
            yield pd.DataFrame(rows, columns=["package", "file", "line", "name", "doc", "parents", "imports"])

    return files.select("package", "file", "how", "text").mapInPandas(run, SCHEMA)
