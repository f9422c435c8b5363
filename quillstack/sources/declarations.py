"""Declarations of Go, Rust and TypeScript sources: comments and strings are blanked, brackets matched once, ranges cut into statements.

A declaration can then span lines, hold further ones at any depth, and stand beside code, comments and strings that look like one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

MAX_DOC = 4000
Symbol = tuple[int, str, str, str, str, str, str | None]

_QUOTED = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"|\'[^\'\\\n]*(?:\\[\s\S][^\'\\\n]*)*\''
_REMARK = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
OPAQUE = {
    "go": re.compile(_REMARK + "|" + _QUOTED + r"|`[^`]*`"),
    "rust": re.compile(r'//[^\n]*|/\*|\bb?r(#*)"[\s\S]*?"\1|\bb?"[^"\\]*(?:\\[\s\S][^"\\]*)*"|"[^"\\]*(?:\\[\s\S][^"\\]*)*"|\'(?:[^\'\\\n]|\\[^\n]{1,10}?)\''),
    "ts": re.compile(_REMARK + "|" + _QUOTED + r"|`[^`\\]*(?:\\[\s\S][^`\\]*)*`|(?<=[=(,:\[!&|?{};\n])[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"),
}
_PAIRS = {")": "(", "]": "[", "}": "{"}


def compact(text: str, most: int) -> str:
    """One line, without space inside brackets; what is longer ends in `` …``."""
    line = " ".join(text.split())
    line = re.sub(r",? \)|,\)", ")", line.replace("( ", "("))
    return line if len(line) <= most else line[:most].rstrip() + " …"


def capped(doc: str) -> str:
    return doc.encode()[:MAX_DOC].decode("utf-8", "ignore")


def block_comment(text: str) -> str:
    """What a block comment says: without its marks, leading stars and common indent."""
    rows = [re.sub(r"^\s*\*(?!/) ?", "", row) for row in re.sub(r"^/\*[*!]?|\*/$", "", text).split("\n")]
    indent = min((len(r) - len(r.lstrip()) for r in rows[1:] if r.strip()), default=0)
    return "\n".join([rows[0].strip(), *[r[indent:].rstrip() for r in rows[1:]]]).strip()


@dataclass
class Statement:
    lead: int  #: where its decorators or attributes begin
    start: int
    end: int
    body: tuple[int, int] | None  #: its braces, if it has a body
    after: int  #: where the statement before it ends
    marks: str  #: its attributes


class Source:
    """A text, ``plain`` without comments and ``code`` without strings too, all of one length; ``ends`` maps opening brackets to closing ones."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang
        self.comments: list[tuple[int, int]] = []
        plain, code, at = [], [], 0
        while m := OPAQUE[lang].search(text, at):
            part, end = m.group(), m.end()
            if part == "/*" and lang == "rust":
                end, part = self._nested(m.start()), text[m.start() : self._nested(m.start())]
            plain.append(text[at : m.start()])
            code.append(text[at : m.start()])
            if part.startswith(("//", "/*")):
                self.comments.append((m.start(), end))
                plain.append(re.sub(r"[^\n]", " ", part))
                code.append(plain[-1])
            else:
                plain.append(part)
                code.append(part[0] + "_" * (len(part) - 2) + part[-1])
            at = end
        self.plain, self.code = "".join([*plain, text[at:]]), "".join([*code, text[at:]])
        self.starts = [s for s, _ in self.comments]
        self.rows = [m.end() for m in re.finditer("\n", text)]
        self.ends = self._brackets()

    def _nested(self, start: int) -> int:
        depth = 0
        for m in re.finditer(r"/\*|\*/", self.text[start:]):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return start + m.end()
        return len(self.text)

    def _brackets(self) -> dict[int, int]:
        """Matching brackets; what is left open ends where the bracket around it does."""
        ends, stack, open_ = {}, [], dict.fromkeys("([{", 0)
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c, p = m.group(), m.start()
            if c in open_:
                stack.append((c, p))
                open_[c] += 1
            elif open_[_PAIRS[c]]:
                while True:
                    kind, at = stack.pop()
                    open_[kind] -= 1
                    ends[at] = p
                    if kind == _PAIRS[c]:
                        break
        return ends | {at: len(self.code) for _, at in stack}

    def line(self, at: int) -> int:
        return bisect_right(self.rows, at) + 1

    def before(self, at: int, first: int) -> int:
        """The last place before ``at`` that isn't space, or ``first - 1``."""
        at -= 1
        while at >= first and self.code[at].isspace():
            at -= 1
        return at

    def remarks(self, a: int, b: int) -> list[tuple[int, int, str]]:
        return [(s, e, self.text[s:e]) for s, e in self.comments[bisect_left(self.starts, a) : bisect_left(self.starts, b)]]

    def _marks(self, at: int, b: int) -> int:
        """Past decorators (``@name(...)``) and attributes (``#[...]``)."""
        pattern = re.compile(r"#!?(?=\[)") if self.lang == "rust" else re.compile(r"@[\w$.]+\s*(?=\()|@[\w$.]+")
        while self.lang != "go" and at < b and (m := pattern.match(self.code, at, b)):
            at = min(self.ends.get(m.end(), m.end() - 1) + 1, b)
            at = re.compile(r"\s*").match(self.code, at, b).end()
        return at

    def statements(self, a: int, b: int, members: bool = False) -> Iterator[Statement]:
        """What stands between ``a`` and ``b``, brackets and bodies as wholes; ``members`` of TypeScript's classes and types also end at commas."""
        gap, stop, at, after = re.compile(r"[\s;,)\]}]*"), re.compile(r"[(\[{;\n,]" if members else r"[(\[{;\n]"), a, a
        while (lead := gap.match(self.code, at, b).end()) < b:
            start = i = self._marks(lead, b)
            body, end, angles, seen = None, b, 0, start
            while m := stop.search(self.code, i, b):
                p, c = m.start(), m.group()
                if c in "([{":
                    i = min(self.ends[p] + 1, b)
                    if c == "{" and self._is_body(start, p):
                        body = (p, min(self.ends[p], b))
                        if self.lang != "go":
                            end = i
                            break
                    continue
                if c == ",":
                    angles, seen = angles + self.angles(seen, p), p
                if c == ";" or (c == "," and angles <= 0) or (c == "\n" and self._is_over(start, p, b, members)):
                    end = p
                    break
                i = p + 1
            if self.lang == "go" and body and self.before(end, start) != body[1]:
                body = None
            yield Statement(lead, start, end, body, after, self.plain[lead:start])
            at = after = max(end, lead + 1)

    def angles(self, a: int, p: int) -> int:
        """How many angle brackets more open than close."""
        part = re.sub(r"[=-]>", "", self.code[a:p])
        return part.count("<") - part.count(">")

    def _is_body(self, start: int, p: int) -> bool:
        q = self.before(p, start)
        last = self.code[q] if q >= start else ""
        word = re.search(r"[\w$]*$", self.code[max(start, q - 20) : q + 1]).group() if q >= start else ""
        if self.lang == "go":
            return word not in ("interface", "struct") and last not in ":=,"
        if self.lang == "rust":
            return last not in "<=" and not (last == "," and self.angles(start, p) > 0) and not re.compile(r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:const|static|type|use|let)\b)(?!\s+(?:async|unsafe|extern|fn)\b)").match(self.code, start, p)
        if last and last in ":=|&<,?(" or self.code[max(start, q - 1) : q + 1] == "=>":
            return False
        return word not in ("extends", "keyof", "as", "satisfies", "export", "import", "type", "infer", "default") and not re.compile(r"(?:(?:export|declare|default)\s+)*(?:const(?!\s+enum\b)|let|var|type|import)\b(?=\s*[\w$*{\[\"'])").match(self.code, start, p)

    def _is_over(self, start: int, p: int, b: int, members: bool) -> bool:
        """Whether a statement ends with its line."""
        if self.lang == "rust":
            return False
        q = self.before(p, start)
        if q < start:
            return False
        last = self.code[q]
        if self.lang == "go":
            return last.isalnum() or last in "_)]}\"'`"
        if last in "=|&<?:+(" or last in ",*-" and not (members and last == ",") or self.code[max(start, q - 1) : q + 1] == "=>":
            return False
        if re.search(r"(?:^|[^\w$.])(?:extends|implements|declare|export|abstract|default|async|function|class|interface|keyof|type|const|from|enum|namespace)$", self.code[max(start, q - 12) : q + 1]):
            return False
        follows = re.compile(r"\s*(?:[|&=?:.{]|\))" if members else r"\s*(?:[|&=?:.{<>+*,)]|(?:extends|implements|from)\b)")
        return not follows.match(self.code, p, b)


# Go


def _go_doc(s: Source, st: Statement) -> str:
    """The comments on the lines directly above, but not one beside the statement before."""
    rows, below = [], s.line(st.lead)
    for a, e, text in reversed(s.remarks(st.after, st.lead)):
        if s.line(e - 1) + 1 != below or st.after and s.line(a) == s.line(st.after - 1):
            break
        rows.append(re.sub(r"^// ?", "", text).rstrip() if text.startswith("//") else block_comment(text))
        below = s.line(a)
    return capped("\n".join(reversed(rows)).strip())


def go_module(text: str) -> tuple[int, str, str]:
    """Line, text and package of the comment on a package; a ``main`` package and one without comment have none."""
    s = Source(text, "go")
    for st in s.statements(0, len(text)):
        if m := re.compile(r"package\s+(\w+)").match(s.code, st.start, st.end):
            first = below = s.line(st.lead)
            for a, e, _ in reversed(s.remarks(st.after, st.lead)):
                if s.line(e - 1) + 1 != below:
                    break
                first = below = s.line(a)
            return first, _go_doc(s, st) if m[1] != "main" else "", m[1]
    return 1, "", ""


def _shown(text: str, most: int, head: int) -> str:
    """A type with its fields, an empty body left out; a long one by its head."""
    text = re.sub(r"\s+\{\s*\}$", "", text.rstrip())
    return compact(text, most) if len(text.encode()) <= most else compact(text[: text.find("{")] if "{" in text else text, head) + " …"


_GO_FUNC = re.compile(r"func\s*(?:\((?P<on>[^()]*)\)\s*)?(?P<name>\w+)")
_GO_TYPE = re.compile(r"(?P<name>\w+)\s*(?P<of>\[(?=[^\]]))?")


def go(text: str) -> Iterator[Symbol]:
    """Exported functions, methods of exported types, types, methods of interfaces, constants and variables, grouped or not; a ``main`` package has none."""
    s = Source(text, "go")
    for st in s.statements(0, len(text)):
        word = re.compile(r"(package|func|type|const|var)\b\s*").match(s.code, st.start, st.end)
        if not word:
            continue
        if word[1] == "package" and s.code[word.end() : st.end].strip() == "main":
            return
        if word[1] == "func" and (m := _GO_FUNC.match(s.code, st.start, st.end)):
            on = re.sub(r"\[.*", "", m["on"] or "", flags=re.S).split()
            owner = on[-1].lstrip("*") if on else ""
            if m["name"][0].isupper() and (m["on"] is None or owner[:1].isupper()):
                sig = compact(s.plain[st.start : st.body[0] if st.body else st.end], 600)
                yield s.line(st.start), "method" if owner else "function", m["name"], f"{owner}.{m['name']}" if owner else m["name"], sig, _go_doc(s, st), None
        elif word[1] in ("type", "const", "var"):
            yield from _go_specs(s, st, word[1], word.end())


def _go_specs(s: Source, st: Statement, word: str, at: int) -> Iterator[Symbol]:
    grouped = s.code[at : at + 1] == "("
    specs = list(s.statements(at + 1, min(s.ends[at], st.end))) if grouped else [Statement(st.lead, at, st.end, None, st.after, "")]
    for spec in specs:
        doc = _go_doc(s, st if len(specs) == 1 else spec)
        line, full = s.line(spec.start), s.plain[spec.start : spec.end]
        if word != "type":
            names = re.match(r"\w+(?:\s*,\s*\w+)*", full)
            for name in re.findall(r"\w+", names[0]) if names else ():
                if name[0].isupper():
                    yield line, "const", name, name, compact(f"{word} {full}", 300), doc, None
            continue
        m = _GO_TYPE.match(s.code, spec.start, spec.end)
        if not m or not m["name"][0].isupper():
            continue
        name, rest = m["name"], s.ends[m.start("of")] + 1 if m["of"] and not re.compile(r"\[\s*\w*\s*\]").match(s.code, m.start("of")) else m.end("name")
        made = re.compile(r"\s*=?\s*interface\s*(?=\{)").match(s.code, rest, spec.end)
        yield line, "interface" if made else "struct", name, name, _shown(f"type {full}", 900, 300), doc, None
        for inner in s.statements(made.end() + 1, min(s.ends[made.end()], spec.end)) if made else ():
            if method := re.compile(r"(\w+)\s*\(").match(s.code, inner.start, inner.end):
                yield s.line(inner.start), "method", method[1], f"{name}.{method[1]}", compact(s.plain[inner.start : inner.end], 400), _go_doc(s, inner), None


# Rust

_RUST = re.compile(
    r"(?P<vis>pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|unsafe|auto|extern(?:\s*\"_*\")?|const(?=\s+(?:async|unsafe|extern|fn)\b))\s+)*"
    r"(?:(?P<word>fn|struct|enum|union|trait|mod|type|const|static)\s+(?:mut\s+)?(?:r#)?(?P<name>\w+)|(?P<impl>impl)\b|macro_rules!\s*(?P<macro>\w+)|(?P<call>[\w:]+)!\s*(?=[{(\[]))"
)
_RUST_KINDS = {"fn": "function", "struct": "struct", "union": "struct", "enum": "enum", "type": "type", "const": "const", "static": "const"}


def _outer_docs(remarks: list[str]) -> list[str]:
    out = []
    for r in remarks:
        if r.startswith("///") and not r.startswith("////"):
            out.append(re.sub(r"^/// ?", "", r).rstrip())
        elif r.startswith("/**") and not r.startswith("/***"):
            out.append(block_comment(r))
    return out


def _implemented(head: str) -> str | None:
    """The type that an inherent ``impl`` (its head after that word) is of; none for one of a trait."""
    head, depth = head.lstrip(), 0
    if head.startswith("<"):
        for m in re.finditer(r"->|[<>]", head):
            depth += {"<": 1, ">": -1}.get(m.group(), 0)
            if not depth:
                head = head[m.end() :]
                break
    head = re.split(r"\bwhere\b", head)[0]
    return None if re.search(r"\bfor\b(?!\s*<)", head) else head.split("<")[0].strip() or None


def rust(text: str) -> Iterator[Symbol]:
    """Public items, those in public modules and in bodies of macro calls, methods of inherent implementations and of traits, exported
    macros; hidden ones are passed over. A macro that wraps an item with docs hands them to the items it is called with."""
    s = Source(text, "rust")
    yield from _rust_items(s, 0, len(text), "", None, None, 0)


def _rust_items(s: Source, a: int, b: int, up: str, owner: tuple[str, bool] | None, given: tuple[str, bool] | None, depth: int) -> Iterator[Symbol]:
    wrappers: dict[str, tuple[str, bool]] = {}
    for st in s.statements(a, b):
        docs = _outer_docs([t for _, _, t in s.remarks(st.after, st.start)]) + [d.replace("\\n", "\n") for d in re.findall(r'#\[doc\s*=\s*"([^"]*)"\s*\]', st.marks)]
        doc, exported = capped("\n".join(docs).strip()), "macro_export" in st.marks or bool(given and given[1])
        doc = doc or (given[0] if given else "")
        m = _RUST.match(s.code, st.start, st.end)
        if not m or re.search(r"doc\s*\(\s*hidden\s*\)", st.marks):
            continue
        public, word, name, line = bool(owner and owner[1]) or (m["vis"] or "").strip() == "pub", m["word"], m["name"], s.line(st.start)
        path = "::".join(p for p in (up, owner[0] if owner else "", name) if p)
        full, head = s.plain[st.start : st.end], s.plain[st.start : st.body[0] if st.body else st.end]
        inside = (st.body[0] + 1, st.body[1]) if st.body else (0, 0)
        if m["impl"]:
            if kind := _implemented(s.code[m.end() : st.body[0] if st.body else st.end]):
                yield from _rust_items(s, *inside, up, (kind, False), given, depth)
        elif m["macro"]:
            wrapped = _outer_docs([t for _, _, t in s.remarks(st.start, st.end) if t.startswith("///")]) if ":item" in full else []
            if wrapped:
                wrappers[m["macro"]] = capped("\n".join(wrapped).strip()), "macro_export" in full
            elif exported:
                yield line, "macro", f"{m['macro']}!", f"{m['macro']}!", compact(full, 300), doc, None
        elif m["call"]:
            opened = m.end()
            if depth < 3 and re.search(r"\b(?:fn|struct|mod|trait)\s|macro_rules!", s.code[opened : st.end]):
                yield from _rust_items(s, opened + 1, min(s.ends[opened], st.end), up, None, wrappers.get(m["call"]) or given, depth + 1)
        elif not public:
            continue
        elif word == "fn":
            yield line, "method" if owner else "function", name, path, compact(head, 600), doc, None
        elif word in ("struct", "enum", "union"):
            yield line, _RUST_KINDS[word], name, path, _shown(full, 900, 400), doc, None
        elif word == "trait":
            yield line, "trait", name, path, compact(head, 400), doc, None
            yield from _rust_items(s, *inside, up, (name, True), given, depth)
        elif word == "mod":
            if doc:
                yield line, "module", name, path, f"pub mod {name}", doc, None
            yield from _rust_items(s, *inside, path, None, given, depth)
        else:
            yield line, _RUST_KINDS[word], name, path, compact(full, 400), doc, None


def rust_module(text: str) -> tuple[int, str]:
    """Line and text of the docs on the file's own module (``//!`` and ``/*!`` outside of items)."""
    s, last, said = Source(text, "rust"), 0, []
    gaps = []
    for st in s.statements(0, len(text)):
        gaps.append((st.after, st.start))
        last = st.end
    for a, b in [*gaps, (last, len(text))]:
        said += [(s.line(p), t) for p, _, t in s.remarks(a, b) if t.startswith(("//!", "/*!"))]
    rows = [re.sub(r"^//! ?", "", t).rstrip() if t.startswith("//") else block_comment(t) for _, t in said]
    return said[0][0] if said else 1, "\n".join(rows)


# TypeScript

_TS = re.compile(
    r"(?P<open>(?:(?:export|default|declare)\s+)*)(?:abstract\s+)?(?:async\s+)?"
    r"(?P<word>function(?:\s*\*)?|class|interface|type|const\s+enum|enum|const|let|var|namespace|module)(?![\w$])\s*(?P<name>[A-Za-z_$][\w$.]*|[\"'][^\"']*[\"']|(?=[\[{]))"
)
_MEMBER = re.compile(r"(?P<how>(?:(?:public|private|protected|static|readonly|abstract|override|declare|async|accessor|get|set)\s+(?=[\w$#\"'\[*]))*)\*?\s*(?P<name>#?[\w$]+|[\"'][^\"']*[\"'])\s*[?!]?\s*(?P<next>[<(:;=]|$)")
_FUNCTION = re.compile(r"\s*(?:async\s+)?(?:function\b|(?:<|\(|[\w$]+\s*=>))")


def _ts_doc(s: Source, st: Statement) -> str:
    for _, e, text in reversed(s.remarks(st.after, st.lead)):
        if text.startswith("/**") and s.line(e - 1) + 2 >= s.line(st.lead):
            return capped(block_comment(text))
        if not text.startswith("//"):
            break
    return ""


def typescript(text: str, file: str = "") -> Iterator[Symbol]:
    """Declarations, those in namespaces, members of classes and interfaces but private ones, and names given by exports; in JavaScript
    files what isn't exported counts if it is documented."""
    s = Source(text, "ts")
    yield from _ts_block(s, 0, len(text), "", file.endswith((".js", ".mjs", ".cjs")))


def _ts_block(s: Source, a: int, b: int, up: str, js: bool) -> Iterator[Symbol]:
    for st in s.statements(a, b):
        line, doc = s.line(st.lead), _ts_doc(s, st)
        if m := re.compile(r"export\s*(?:type\s*)?(?=\{)|export\s*(?:type\s*)?\*\s*as\s+(?P<all>[\w$]+)").match(s.code, st.start, st.end):
            sig = compact(s.plain[st.start : st.end], 200)
            if m["all"]:
                yield line, "module", m["all"], up + m["all"], sig, doc, None
            else:
                for one in re.compile(r"(?:^|(?<=[{,\s]))([\w$]+)\s+as\s+([\w$]+)").finditer(s.code, m.end(), min(s.ends[m.end()], st.end)):
                    if one[2] not in ("default", one[1]):
                        yield s.line(one.start()), "re-export", one[2], up + one[2], sig, "", one[1]
            continue
        m = _TS.match(s.code, st.start, st.end)
        if not m or js and not (doc or up or "export" in m["open"]):
            continue
        word, at = m["word"].split()[0].rstrip("*"), m.end("open")
        name, path = m["name"], up + m["name"]
        head = s.plain[at : st.body[0] if st.body else st.end]
        if word in ("const", "let", "var") and not re.match(r"const\s+enum", m["word"]):
            yield from _ts_values(s, word, m.end("word"), st.end, up, line, doc)
        elif word in ("namespace", "module"):
            quoted = name[:1] in "\"'"
            if not st.body:
                continue
            if not quoted:
                yield line, "module", name, path, compact(head, 200), doc, None
            yield from _ts_block(s, st.body[0] + 1, st.body[1], up if quoted else path + ".", js)
        elif not name or name[0] in "\"'":
            continue
        elif word == "function":
            yield line, "function", name, path, compact(head, 600), doc, None
        elif word in ("class", "interface"):
            yield line, word, name, path, compact(head, 400), doc, None
            if st.body:
                yield from _ts_members(s, *st.body, path)
        else:
            yield line, "type" if word == "type" else "enum", name, path, compact(s.plain[at : st.end], 700 if word == "type" else 500), doc, None


def _ts_values(s: Source, word: str, a: int, b: int, up: str, line: int, doc: str) -> Iterator[Symbol]:
    """Each name of a ``const``; those that hold functions are such."""
    begin, i, parts, angles, seen, stop = a, a, [], 0, a, re.compile(r"[(\[{,]")
    while m := stop.search(s.code, i, b):
        i = min(s.ends[m.start()] + 1, b) if m.group() != "," else m.end()
        if m.group() == ",":
            angles, seen = angles + s.angles(seen, m.start()), m.start()
            if angles <= 0:
                parts.append((begin, m.start()))
                begin, angles = i, 0
    for p, q in [*parts, (begin, b)]:
        if not (m := re.compile(r"\s*([A-Za-z_$][\w$]*)\s*(?=[!:=]|$)").match(s.code, p, q)):
            continue
        equals, i = None, m.end()
        while t := re.compile(r"=>|==+|[(\[{=]").search(s.code, i, q):
            if t.group() == "=":
                equals = t.start()
                break
            i = min(s.ends[t.start()] + 1, q) if t.group() in "([{" else t.end()
        typed, value = s.code[m.end() : equals if equals is not None else q], equals + 1 if equals is not None else q
        body = _function_body(s, value, q)
        if body is not None:
            sig = s.plain[p:body]
        elif q - value > 300:
            sig = s.plain[p:value] + " …"
        else:
            sig = s.plain[p:q]
        yield line, "function" if body is not None or "=>" in typed else "const", m[1], up + m[1], compact(f"{word} {sig}", 600), doc, None


def _function_body(s: Source, a: int, b: int) -> int | None:
    """Where the body of a function begins that is the value from ``a``; none for other values."""
    if not _FUNCTION.match(s.code, a, b):
        return None
    plain, i = re.compile(r"\s*(?:async\s+)?function\b").match(s.code, a, b), a
    while t := re.compile(r"=>|[(\[{]").search(s.code, i, b):
        if t.group() == "=>" and not plain:
            return t.start()
        if t.group() == "{" and plain and s._is_body(a, t.start()):
            return t.start()
        i = min(s.ends[t.start()] + 1, b) if t.group() != "=>" else t.end()
    return None


def _ts_members(s: Source, a: int, b: int, up: str) -> Iterator[Symbol]:
    for st in s.statements(a + 1, b, members=True):
        m = _MEMBER.match(s.code, st.start, st.end)
        if not m or re.search(r"\b(?:private|protected)\b", m["how"]):
            continue
        name = s.plain[m.start("name") : m.end("name")].strip("\"'")
        if name.startswith(("#", "_", "[")) or name == "new" and m["next"] in "(<":
            continue
        kind = "method" if m["next"] and m["next"] in "(<" else "field"
        sig = compact(s.plain[st.start : st.body[0] if st.body and kind == "method" else st.end], 500)
        yield s.line(st.start), kind, name, f"{up}.{name}", sig, _ts_doc(s, st), None
