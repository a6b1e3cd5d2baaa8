"""Symbols and raw references of Rust and TypeScript sources, found by a tolerant scan.

Comments, strings and character literals are blanked first, so that offsets stay; then declarations and
calls are found by pattern, and the nesting of braces gives each its scope and its enclosing function.
Malformed input gives what can be recognised and never an error. Spans are in bytes and 1-based lines.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.schemas import EDGE_KINDS, SYMBOL_KINDS

NOT_CALLS = {"if", "for", "while", "match", "return", "switch", "catch", "function", "fn", "loop", "in", "as", "super", "typeof", "await", "new", "constructor", "import"}

_NOISE = {
    "rust": re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|r(\#*)".*?(?:"\1|\Z)|b?"(?:\\.|[^"\\])*(?:"|\Z)|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'""", re.S),
    "typescript": re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*(?:"|$)|'(?:\\.|[^'\\\n])*(?:'|$)|`(?:\\.|[^`\\])*(?:`|\Z)""", re.S | re.M),
}
_NAME = r"[A-Za-z_$][\w$]*"
_DECLARED = {
    "rust": re.compile(rf"""\b(?P<kind>fn|struct|union|enum|trait|mod|const|static|type)\s+(?:mut\s+)?(?P<name>{_NAME})|\b(?P<impl>impl)\b(?P<head>[^{{;]*)|\b(?P<macro>macro_rules!)\s*(?P<mname>{_NAME})"""),
    "typescript": re.compile(rf"""\b(?P<kind>function\s*\*?|class|interface|enum|namespace|module|type)\s+(?P<name>{_NAME})(?P<head>[^{{;=(]*)|\b(?:const|let|var)\s+(?P<var>{_NAME})\s*(?::[^=;]+)?=\s*(?P<fun>(?:async\s+)?(?:function\b|(?:<[^>]*>\s*)?(?:\([^()]*\)|{_NAME})\s*(?::[^=;{{]+)?=>))?|^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(?P<method>{_NAME})\s*(?:<[^>]*>)?\([^()]*\)\s*(?::[^{{;]+)?(?=\{{|;)""", re.M),
}
_CALL = re.compile(rf"(?P<macro>{_NAME}!\s*[(\[{{])|(?P<name>{_NAME})(?:::<[^<>()]*>|<[^<>()]*>)?\s*\(")
_KINDS = {
    "fn": "Function", "struct": "Struct", "union": "Struct", "enum": "Enum", "trait": "Trait", "mod": "Module", "const": "Variable", "static": "Variable", "type": "TypeAlias",
    "function": "Function", "class": "Struct", "interface": "Trait", "namespace": "Module", "module": "Module",
}
_SCOPES = {"Trait", "Impl", "Module"}


def _blank(text: str, language: str) -> str:
    return _NOISE[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _body_end(text: str, start: int) -> tuple[int, int]:
    """Where the braces that open after ``start`` (before any ``;``) begin and end; without braces the statement's end."""
    m = re.compile(r"[{;]").search(text, start)
    if not m:
        return -1, len(text)
    if m[0] == ";":
        return -1, m.end()
    depth = 0
    for b in re.compile(r"[{}]").finditer(text, m.start()):
        depth += 1 if b[0] == "{" else -1
        if depth == 0:
            return m.start(), b.end()
    return m.start(), len(text)


def _leaf(name: str) -> str:
    return re.split(r"::|[.:]", re.sub(r"<.*", "", name.strip(), flags=re.S).strip())[-1].strip().lstrip("&").strip()


def parse(text: str, language: str) -> tuple[list[dict], list[dict]]:
    """(symbols, references) of one file; references carry the qualified name of their origin."""
    clean = _blank(text, language)
    found = []  # (start, body, end, name, kind, implemented types)
    hidden = []  # token trees of macros: what they hold is not parsed
    for m in _CALL.finditer(clean) if language == "rust" else ():
        if m["macro"]:
            close = {"(": ")", "[": "]", "{": "}"}[m["macro"][-1]]
            depth, at = 1, m.end()
            while at < len(clean) and depth:
                depth += (clean[at] == m["macro"][-1]) - (clean[at] == close)
                at += 1
            hidden.append((m.start(), at))
    covered = lambda p: any(a <= p < b for a, b in hidden)
    for m in _DECLARED[language].finditer(clean):
        g = m.groupdict()
        if covered(m.start()) and not g.get("macro"):
            continue
        above: list[str] = []
        if g.get("impl"):
            head = re.sub(r"^\s*<[^>]*>", "", g["head"]).split(" where ")[0]
            if not clean[m.end() :].startswith("{"):
                continue
            trait, _, target = head.rpartition(" for ")
            name, kind, above = _leaf(target), "Impl", [_leaf(trait)] if trait else []
        elif g.get("macro"):
            name, kind = g["mname"], "Macro"
        elif g.get("var"):
            name, kind = g["var"], "Function" if g["fun"] else "Variable"
        elif g.get("method"):
            if g["method"] in NOT_CALLS - {"constructor"} or not any(a < m.start() < b and k in ("Struct", "Trait") for a, _, b, _, k, _ in found):
                continue
            name, kind = g["method"], "Function"
        else:
            name, kind = g["name"], _KINDS[g["kind"].split()[0].rstrip("*").strip()] if g["kind"].strip() != "type" else "TypeAlias"
            if language == "typescript" and kind == "Struct":
                above = [_leaf(x) for x in re.sub(r"^.*?\bimplements\b", "", g["head"], flags=re.S).split(",")] if "implements" in g["head"] else []
        if not name:
            continue
        body, end = _body_end(clean, m.end())
        start = m.start("method") if g.get("method") else m.start()
        found.append((start, body, end, name, kind, above))
    scopes = _SCOPES | ({"Struct"} if language == "typescript" else set())

    def qualified(start: int, name: str) -> str:
        return "::".join([n for a, b, e, n, k, _ in found if k in scopes and b >= 0 and b <= start < e and a < start] + [name])

    at = [0]
    for c in text:
        at.append(at[-1] + len(c.encode("utf-8", "replace")))
    line = lambda p: text.count("\n", 0, p) + 1
    column = lambda p: p - (text.rfind("\n", 0, p) + 1) + 1
    symbols, references = [], []
    for start, _, end, name, kind, above in found:
        q = qualified(start, name)
        last = max(start, end - 1)
        symbols.append({"name": name, "qualified_name": q, "kind": SYMBOL_KINDS[kind], "start_byte": at[start], "end_byte": at[end], "start_line": line(start), "end_line": line(last), "start_column": column(start), "end_column": column(last) + 1, "content_hash": hashlib.sha256(text[start:end].encode("utf-8", "replace")).hexdigest()})
        references += [{"from_qualified_name": q, "to_name": t, "kind": EDGE_KINDS["Implements"], "start_line": line(start), "end_line": line(start)} for t in above if t]
    functions = [(a, b, e, n) for a, b, e, n, k, _ in found if k == "Function" and b >= 0 or k == "Function" and language == "typescript"]
    names_at = {clean.find(n, a) for a, _, _, n, _, _ in found}
    for m in _CALL.finditer(clean):
        if m["macro"] or covered(m.start()) or m["name"] in NOT_CALLS or m.start("name") in names_at or re.search(r"\bnew\s+$", clean[: m.start()][-20:]):
            continue
        inside = [(a, n) for a, b, e, n in functions if max(a, b) <= m.start() < e]
        owners = inside[-1:] if language == "rust" else inside[-2:] if len(inside) > 1 and clean[inside[-1][0] :].startswith(("const", "let", "var")) else inside[-1:]
        for start, name in owners:
            references.append({"from_qualified_name": qualified(start, name), "to_name": m["name"], "kind": EDGE_KINDS["Calls"], "start_line": line(m.start()), "end_line": line(m.start())})
    return symbols, references


_STRING, _INT, _LONG = ("string", pa.string()), ("int", pa.int32()), ("bigint", pa.int64())
_SYMBOL = {"name": _STRING, "qualified_name": _STRING, "kind": _INT, "start_byte": _LONG, "end_byte": _LONG, "start_line": _INT, "end_line": _INT, "start_column": _INT, "end_column": _INT, "content_hash": _STRING, "ord": _INT}
_REFERENCE = {"from_qualified_name": _STRING, "to_name": _STRING, "kind": _INT, "start_line": _INT, "end_line": _INT, "ord": _INT}


def _struct(fields: dict) -> str:
    return "array<struct<" + ",".join(f"{k}:{t}" for k, (t, _) in fields.items()) + ">>"


PARSED = f"rel_path string, language string, symbols {_struct(_SYMBOL)}, refs {_struct(_REFERENCE)}, errors array<string>"


def _arrow_schema() -> pa.Schema:
    lists = {name: pa.list_(pa.struct([(k, t) for k, (_, t) in fields.items()])) for name, fields in (("symbols", _SYMBOL), ("refs", _REFERENCE))}
    return pa.schema([("rel_path", pa.string()), ("language", pa.string()), *lists.items(), ("errors", pa.list_(pa.string()))])


def parse_tree(files: DataFrame) -> DataFrame:
    """A row per file of (rel_path, language, content) with its symbols, references and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()
        for batch in batches:
            rows = []
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns)):
                if language not in _DECLARED:
                    rows.append({"rel_path": path, "language": language, "symbols": [], "refs": [], "errors": ["unsupported language"]})
                    continue
                symbols, references = parse(content or "", language)
                rows.append({"rel_path": path, "language": language, "symbols": [s | {"ord": i} for i, s in enumerate(symbols)], "refs": [r | {"ord": i} for i, r in enumerate(references)], "errors": []})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("rel_path", "language", "content").mapInArrow(run, PARSED)


def raw_symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select("rel_path", F.inline("symbols"))


def raw_references(parsed: DataFrame) -> DataFrame:
    return parsed.select("rel_path", F.inline("refs"))
