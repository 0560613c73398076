"""Parsers of source artifacts, for workers: declared names with scope and place, prose regions, counts. Offsets are characters here.

A parser that can't read a text claims nothing: it gives no names, no regions and no counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from twinframe import vocab

Name = tuple[str, str, str, int, int]  # scope, type, name, start, end

# Declaration keywords of diagrams and the type each declares, longest first.
KEYWORDS = {
    "abstract class": "dto", "annotation": "interface", "participant": "service", "collections": "service", "rectangle": "service",
    "component": "service", "interface": "interface", "namespace": "path_segment", "protocol": "interface", "boundary": "service",
    "database": "table", "abstract": "dto", "artifact": "service", "usecase": "endpoint", "storage": "service", "control": "service",
    "package": "path_segment", "folder": "path_segment", "object": "dto", "struct": "dto", "entity": "dto", "actor": "service",
    "queue": "event", "frame": "service", "cloud": "service", "agent": "service", "class": "dto", "card": "service", "node": "service",
    "enum": "enum",
}
DECLARATION = r"^[ \t]*(" + "|".join(k.replace(" ", r"\s+") for k in KEYWORDS) + r")[ \t]+(?:\"([^\"\n]+)\"(?:[ \t]+as[ \t]+(\w+))?|(\w[\w.]*)(?:[ \t]+as[ \t]+\"([^\"\n]+)\")?)"
# Lines that configure how a diagram is drawn.
RENDERER = ("skinparam", "!", "hide ", "show ", "scale ", "@start", "@end", "left to right", "top to bottom")
_declared = re.compile(DECLARATION, re.M)
_person = re.compile(r"[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){1,2}")
_arrow = re.compile(r"<?[|o*]?(?:-+|\.+)(?:\[[^\]\n]*\])?(?:-*|\.*)[|o*]?>{0,2}")
_member = re.compile(r"^[ \t]*(?:\{\w+\}[ \t]*)?[-+#~*]?[ \t]*(\w+)[ \t]*(\()?", re.M)


def _bodies(text: str) -> list[tuple[int, int, str]]:
    """Start and end of the braces that open on a declaration's own line, and whose they are."""
    out = []
    for m in _declared.finditer(text):
        opening = re.compile(r"[^\n{]*\{").match(text, m.end())
        if not opening:
            continue
        depth = 1
        for brace in re.compile(r"[{}]").finditer(text, opening.end()):
            depth += 1 if brace[0] == "{" else -1
            if not depth:
                out.append((opening.end(), brace.start(), m[2] or m[4]))
                break
    return out


def plantuml_names(text: str) -> list[Name]:
    out = []
    for m in _declared.finditer(text):
        keyword = " ".join(m[1].split())
        for g in (2, 3, 4, 5):
            if m[g]:
                kind = "person" if keyword == "actor" and _person.fullmatch(m[g]) else KEYWORDS[keyword]
                out.append((f"puml::{m[g]}", kind, m[g], m.start(g), m.end(g)))
    for s, e, owner in _bodies(text):
        for m in _member.finditer(text[s:e]):
            out.append((f"puml::{owner}.{m[1]}", "endpoint" if m[2] else "column", m[1], s + m.start(1), s + m.end(1)))
    return out


def plantuml_regions(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        if not line.strip().lower().startswith(RENDERER):
            out.append((at, at + len(line)))
        at += len(line)
    return out


def plantuml_counts(text: str) -> dict[str, int] | None:
    """Null without a diagram. Arrows count outside declarations and bodies, where a member may look like one."""
    lines = [x.strip().lower() for x in text.split("\n")]
    begins = sum(x.startswith("@start") for x in lines)
    if not begins:
        return None
    bodies, at, arrows = _bodies(text), 0, 0
    for line in text.splitlines(keepends=True):
        if not any(s <= at < e for s, e, _ in bodies) and not _declared.match(line):
            arrows += sum(len(m[0]) > 1 for m in _arrow.finditer(line))
        at += len(line)
    kinds = Counter(" ".join(m[1].split()) for m in _declared.finditer(text))
    whole = {"diagrams": begins, "ends": sum(x.startswith("@end") for x in lines), "declarations": kinds.total(), "arrows": arrows}
    whole |= {"open_braces": text.count("{"), "close_braces": text.count("}"), "notes": sum(x.startswith("note ") for x in lines), "lines": len(lines)}
    return whole | {f"keyword {k}": n for k, n in kinds.items()}


_sql_token = re.compile(
    r"(?P<skip>\s+|--[^\n]*|/\*[\s\S]*?\*/)|(?P<text>'(?:[^']|'')*')|(?P<name>\"(?:[^\"]|\"\")+\"|`[^`]+`|\[[A-Za-z_][^\]\n]*\]|[^\W\d][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>\S)"
)
# Types of the standard and of common dialects; any other type of a column is one of the schema's own.
SQL_TYPES = set("""bigint bigserial binary bit blob bool boolean bytea char character clob date datetime datetime2 decimal double enum float float4 float8
int int2 int4 int8 integer interval json jsonb long longtext mediumint mediumtext money nchar number numeric nvarchar real serial set
smallint smallserial string text time timestamp timestamptz tinyint tinytext uniqueidentifier uuid varbinary varchar xml year""".split())  # fmt: skip


class _Sql:
    """Statements of a DDL script as lists of tokens (kind, text, start, end); ``ok`` is false where a string, comment or bracket isn't closed."""

    def __init__(self, text: str):
        self.ok, self.statements, depth, at = True, [[]], 0, 0
        while at < len(text):
            m = _sql_token.match(text, at)
            kind, t = m.lastgroup, m[0]
            if kind == "mark" and (t in "'\"`" or t == "/" and text.startswith("/*", at)):
                self.ok = False
            depth += (kind == "mark") * ((t == "(") - (t == ")"))
            self.ok &= depth >= 0
            if kind == "mark" and t == ";" and not depth:
                self.statements.append([])
            elif kind != "skip":
                quoted = kind == "name" and t[0] in "\"`["
                self.statements[-1].append((kind, t[1:-1] if quoted else t, m.start() + quoted, m.end() - quoted, t.lower() if not quoted else ""))
            at = m.end()
        self.ok &= depth == 0
        self.statements = [s for s in self.statements if s]

    @staticmethod
    def words(tokens, at: int, *wanted: str) -> bool:
        return [t[4] for t in tokens[at : at + len(wanted)]] == list(wanted)

    @staticmethod
    def qualified(tokens, at: int) -> tuple[list, int]:
        """The parts of a dotted name and where it ends."""
        parts = []
        while at < len(tokens) and tokens[at][0] == "name":
            parts.append(tokens[at])
            at += 1
            if not (at < len(tokens) and tokens[at][1] == "."):
                break
            at += 1
        return parts, at

    @staticmethod
    def items(tokens, at: int) -> Iterator[list]:
        """The comma-separated items of the brackets that open at a token."""
        depth, item = 0, []
        for t in tokens[at:]:
            closing = t[1] == ")" and t[0] == "mark"
            depth += (t[1] == "(" and t[0] == "mark") - closing
            if not depth or depth == 1 and t[1] == ",":
                yield item
                item = []
                if not depth:
                    return
            elif not (depth == 1 and t[1] == "(" and not item and t is tokens[at]):
                item.append(t)


def _sql_objects(text: str) -> Iterator[tuple]:
    """("table", parts, items), ("index", parts, table, items) and ("type", parts) of a script; nothing where it isn't closed."""
    script = _Sql(text)
    if not script.ok:
        return
    for s in script.statements:
        if not s or s[0][4] != "create":
            continue
        at = 1
        while at < len(s) and s[at][4] in ("or", "replace", "temporary", "temp", "unique", "global", "local", "unlogged"):
            at += 1
        kind, at = s[at][4] if at < len(s) else "", at + 1
        if script.words(s, at, "concurrently"):
            at += 1
        if script.words(s, at, "if", "not", "exists"):
            at += 3
        parts, at = ([], at) if script.words(s, at, "on") else script.qualified(s, at)
        if kind == "table" and parts and at < len(s) and s[at][1] == "(":
            yield "table", parts, list(script.items(s, at))
        elif kind == "index" and script.words(s, at, "on"):
            table, at = script.qualified(s, at + 1)
            if script.words(s, at, "using"):
                at += 2
            yield "index", parts, table, list(script.items(s, at)) if at < len(s) and s[at][1] == "(" else []
        elif kind == "type" and parts:
            yield "type", parts


CONSTRAINTS = ("primary", "foreign", "unique", "check", "constraint", "exclude", "key", "index")


def sql_names(text: str) -> list[Name]:
    out: dict[int, Name] = {}

    def say(parts, kind: str, scope: str) -> None:
        for p in parts:
            out.setdefault(p[2], (scope, kind, p[1], p[2], p[3]))

    def references(item) -> None:
        for k, t in enumerate(item):
            if t[4] == "references":
                table, at = _Sql.qualified(item, k + 1)
                if table:
                    say(table, "table", f"sql::{table[-1][1]}")
                    if at < len(item) and item[at][1] == "(":
                        for column in _Sql.items(item, at):
                            say(column[:1], "column", f"sql::{table[-1][1]}.{column[0][1]}" if column else "")

    for kind, parts, *rest in _sql_objects(text):
        name = parts[-1][1] if parts else ""
        if kind == "type":
            say(parts, "enum", f"sql::{name}")
        elif kind == "table":
            say(parts, "table", f"sql::{name}")
            for item in rest[0]:
                if item and item[0][0] == "name" and item[0][4] not in CONSTRAINTS:
                    say(item[:1], "column", f"sql::{name}.{item[0][1]}")
                    own, _ = _Sql.qualified(item, 1)
                    if own and own[-1][4] not in SQL_TYPES and own[0][4] not in ("references", "not", "null", "primary", "default", "unique", "generated"):
                        say(own, "enum", f"sql::{own[-1][1]}")
                references(item)
        else:
            table, items = rest
            say(parts, "index", f"sql::{name}")
            if table:
                say(table, "table", f"sql::{table[-1][1]}")
                for item in items:
                    if item and item[0][0] == "name" and not any(t[1] == "(" for t in item):
                        say(item[:1], "column", f"sql::{table[-1][1]}.{item[0][1]}")
    return [out[k] for k in sorted(out)]


def sql_counts(text: str) -> dict[str, int] | None:
    script = _Sql(text)
    if not script.ok:
        return None
    out = {"statements": len(script.statements), "tables": 0, "columns": 0, "constraints": 0, "indexes": 0, "types": 0}
    for kind, _, *rest in _sql_objects(text):
        out[{"table": "tables", "index": "indexes", "type": "types"}[kind]] += 1
        for item in rest[0] if kind == "table" else ():
            if item:
                out["constraints" if item[0][4] in CONSTRAINTS else "columns"] += 1
    return out


_code_token = re.compile(r"(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<text>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<other>[\s\S])")
SUFFIXES = sorted(vocab.TYPED_SUFFIXES, key=lambda s: -len(s[0]))
DECLARING = {"class": "service", "function": "service", "interface": "dto", "type": "dto", "enum": "enum"}


def code_tokens(text: str) -> list[tuple[str, str, int, int]] | None:
    """(kind, text, start, end) without white space; null if a string, a comment or a bracket isn't closed."""
    out, stack = [], []
    for m in _code_token.finditer(text):
        t = m[0]
        if m.lastgroup == "other":
            if t.isspace():
                continue
            if t in "\"'`" or t == "/" and text.startswith("/*", m.start()):
                return None
            if t in "([{":
                stack.append(t)
            elif t in ")]}" and (not stack or stack.pop() != "([{"[")]}".index(t)]):
                return None
        out.append((m.lastgroup, t, m.start(), m.end()))
    return None if stack else out


def _block(code: list, at: int) -> int:
    """The token after the brackets that open at a token."""
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k][1] in ("{", "(", "[")) - (code[k][1] in ("}", ")", "]"))
        if not depth:
            return k + 1
    return len(code)


def typescript_names(text: str, module: str = "ts") -> list[Name]:
    tokens = code_tokens(text)
    if tokens is None:
        return []
    code = [t for t in tokens if t[0] != "comment"]
    known: dict[str, tuple[str, str]] = {}  # name -> type, scope
    members: set[str] = set()
    out: dict[int, Name] = {}
    is_ = lambda k, *t: 0 <= k < len(code) and code[k][1] in t

    def typed(name: str, kind: str) -> str:
        return next((k for s, k in SUFFIXES if name.endswith(s) and len(name) > len(s)), kind)

    for k, (kind, t, *_) in enumerate(code):
        after = code[k + 1 + is_(k + 1, "*")] if k + 1 + is_(k + 1, "*") < len(code) else ("", "", 0, 0)
        if kind == "name" and t in DECLARING and after[0] == "name" and not is_(k - 1, ".") and not (t == "type" and is_(k - 1, "{", ",", "import")):
            known[after[1]] = (typed(after[1], DECLARING[t]), f"{module}::{after[1]}")
            if t == "interface":
                body = next((j for j in range(k, len(code)) if code[j][1] == "{"), len(code))
                j, end = body + 1, _block(code, body) - 1
                while j < end:  # the interface's own members: nested types are passed over
                    start = j + is_(j, "readonly")
                    if start < end and code[start][0] == "name" and (is_(start + 1, ":") or is_(start + 1, "?") and is_(start + 2, ":")):
                        members.add(code[start][1])
                        out[code[start][2]] = ("ts::property", "column", *code[start][1:])
                    while j < end and not is_(j, ";", ","):
                        nested = is_(j, "{", "(", "[")
                        j = _block(code, j) if nested else j + 1
                        if j < end and "\n" in text[code[j - 1][3] : code[j][2]] and not is_(j, "|", "&", ";", ",") and not is_(j - 1, "|", "&", ":"):
                            break
                    j += is_(j, ";", ",")
        if kind == "name" and t == "import" and not is_(k + 1, "(", "."):
            source = next((j for j in range(k, min(len(code), k + 400)) if code[j][0] == "text"), None)
            if source is None:
                continue
            path = code[source][1][1:-1]
            if path.startswith("."):
                folder = module.rsplit("/", 1)[0] if "/" in module else ""
                declaring = "/".join(x for x in [folder, re.sub(r"^(\./)+", "", re.sub(r"\.[jt]sx?$", "", path))] if x)
                for j in range(k + 1, source):
                    if code[j][0] == "name" and code[j][1] not in ("type", "from", "as") and not is_(j + 1, "as"):
                        known.setdefault(code[j][1], (typed(code[j][1], "service"), f"{declaring}::{code[j][1]}"))
                stem = re.sub("(" + "|".join(e.replace(".", r"\.") for e in vocab.MODULE_EXTENSIONS) + ")$", "", path)
                for p in re.finditer(r"[^./][^/]*", stem):
                    at = code[source][2] + 1 + p.start()
                    out[at] = ("path", "path_segment", p[0], at, at + len(p[0]))
    for k, (kind, t, s, e) in enumerate(code):
        if kind == "name" and s not in out:
            if is_(k - 1, ".") or is_(k + 1, ":") and t in members and t not in known:
                if t in members:
                    out[s] = ("ts::property", "column", t, s, e)
            elif t in known:
                out[s] = (known[t][1], known[t][0], t, s, e)
    return [out[k] for k in sorted(out)]


def typescript_regions(text: str) -> list[tuple[int, int]] | None:
    """Comments, and strings without their quotes."""
    tokens = code_tokens(text)
    if tokens is None:
        return None
    return [(s + (kind == "text"), e - (kind == "text")) for kind, _, s, e in tokens if kind in ("comment", "text")]


def typescript_counts(text: str) -> dict[str, int] | None:
    code = code_tokens(text)
    if code is None:
        return None
    names = Counter(t for kind, t, *_ in code if kind == "name")
    after_dot = sum(a[1] == "." and b[0] == "name" for a, b in zip(code, code[1:]))
    words = ("class", "function", "interface", "type", "enum", "import", "export")
    return {w: names[w] for w in words} | {"names": names.total(), "properties": after_dot, "braces": sum(t[1] == "{" for t in code)}


def nodes(text: str) -> list[tuple[str, str, str, int, int]] | None:
    """(path, key or value, text, start, end) of a YAML or JSON document; null if it doesn't parse."""
    import yaml

    out = []

    def walk(node, path):
        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                here = f"{path}.{k.value}" if path else str(k.value)
                out.append((here, "key", str(k.value), k.start_mark.index, k.end_mark.index))
                walk(v, here)
        elif isinstance(node, yaml.SequenceNode):
            for i, v in enumerate(node.value):
                walk(v, f"{path}[{i}]")
        elif node is not None:
            out.append((path, "value", str(node.value), node.start_mark.index, node.end_mark.index))

    try:
        for doc in yaml.compose_all(text, Loader=yaml.SafeLoader):
            walk(doc, "")
    except yaml.YAMLError:
        return None
    return out


def yaml_counts(text: str) -> dict[str, int] | None:
    import yaml

    out = Counter(documents=0, mappings=0, sequences=0, scalars=0, keys=0, max_depth=0)

    def walk(node, level):
        out["max_depth"] = max(out["max_depth"], level)
        if isinstance(node, yaml.MappingNode):
            out["mappings"] += 1
            out["keys"] += len(node.value)
            for pair in node.value:
                for x in pair:
                    walk(x, level + 1)
        elif isinstance(node, yaml.SequenceNode):
            out["sequences"] += 1
            for x in node.value:
                walk(x, level + 1)
        else:
            out["scalars"] += 1

    try:
        for doc in yaml.compose_all(text, Loader=yaml.SafeLoader):
            out["documents"] += 1
            walk(doc, 1)
    except yaml.YAMLError:
        return None
    return dict(out)


SCHEMAS = r"components\.schemas\.[^.]+"


def openapi_counts(text: str) -> dict[str, int] | None:
    base, found = yaml_counts(text), nodes(text)
    if base is None or found is None:
        return None
    keys = [p for p, what, *_ in found if what == "key"]
    return base | {
        "schemas": sum(bool(re.fullmatch(SCHEMAS, p)) for p in keys),
        "paths": sum(bool(re.fullmatch(r"paths\.[^.]+", p)) for p in keys),
        "operations": sum(what == "value" and p.endswith(".operationId") for p, what, *_ in found),
    }


def openapi_names(text: str) -> list[Name]:
    found = nodes(text) or []
    enums = {p.split(".")[2] for p, what, *_ in found if what == "key" and re.fullmatch(SCHEMAS + r"\.enum", p)}
    schema = lambda name: "enum" if name in enums else "dto"
    values = ((r"info\.title", "api"), (SCHEMAS + r"\.required\[\d+\]", "column"), (r".*\.operationId", "endpoint"), (r".*parameters\[\d+\]\.name", "column"))
    out: dict[int, Name] = {}
    for path, what, name, s, e in found:
        quote = text[s : s + 1] in ("'", '"')
        s, e = s + quote, e - quote
        parts = path.split(".")
        if what == "key":
            if re.fullmatch(SCHEMAS, path):
                out.setdefault(s, (f"openapi::components.schemas.{name}", schema(name), name, s, e))
            elif re.fullmatch(SCHEMAS + r"\.properties\.[^.]+", path):
                out.setdefault(s, (f"openapi::components.schemas.{parts[2]}.{name}", "column", name, s, e))
            elif path == f"paths.{name}":
                for m in re.finditer(r"(?<=/)[^/{}]+(?=/|$)|(?<=\{)[^{}]+(?=\})", name):
                    kind = "column" if name[m.start() - 1] == "{" else "endpoint"
                    out.setdefault(s + m.start(), (f"openapi::{path}", kind, m[0], s + m.start(), s + m.end()))
        elif path.endswith("$ref") and (tail := name.rsplit("/", 1)[-1]) and "/" in name:
            out.setdefault(e - len(tail), (f"openapi::components.schemas.{tail}", schema(tail), tail, e - len(tail), e))
        else:
            kind = next((k for p, k in values if re.fullmatch(p, path)), None)
            if kind:
                scope = f"components.schemas.{parts[2]}.{name}" if ".required[" in path else path
                out.setdefault(s, (f"openapi::{scope}", kind, name, s, e))
    return [out[k] for k in sorted(out)]
