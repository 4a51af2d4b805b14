"""Text formats: JSON, YAML (a common subset), CSV, XML, Markdown, HTML. Pure functions, and a Column for them.

Objects are dicts, arrays lists; numbers are int or float, and are written as ECMAScript writes them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import RESERVED, number, own_order, text_json, to_json

FORMATS = ("json", "yaml", "csv", "xml", "markdown", "html")
MAX_INPUT, MAX_DEPTH = 20_000_000, 100
SAFE = 2**53 - 1
DEEP = f"transform nests more than {MAX_DEPTH} levels deep"


def parse_json(text: str) -> Any:
    def whole(s: str) -> int | float:
        return int(s) if abs(int(s)) <= SAFE else float(s)

    def strict(name: str) -> Any:
        raise ValueError(f"{name} is no JSON")

    return json.loads(text, parse_int=whole, parse_constant=strict)


# ---------- YAML ----------

PLAIN_NUMBER = re.compile(r"-?\d+(\.\d+)?|-?\d(\.\d+)?[eE][+-]?\d+", re.A)
INT = re.compile(r"-?(0|[1-9]\d*)", re.A)
FLOAT = re.compile(r"-?\d*\.\d+|-?\d(\.\d+)?[eE][+-]?\d+", re.A)
DASH = re.compile(r"-(?=\s|$)")


def must_quote(s: str) -> bool:
    """Whether a text would be read as something else, or not at all, if it stood bare."""
    return s == "" or s.lower() in ("true", "false", "null", "~") or PLAIN_NUMBER.fullmatch(s) is not None or any(c in ":#[]{}&*!|>'\"%@`,\n\r\t" for c in s) or s[0] in "?-" or s[0].isspace() or s[-1].isspace()


def to_yaml(v: Any, level: int = 0) -> str:
    """Block style, two blanks a level; a sequence or mapping in a sequence starts on the dash's line."""
    if level > MAX_DEPTH:
        raise ValueError(DEEP)
    pad = "  " * level

    def bare(x: Any) -> str:
        if isinstance(x, str):
            return text_json(x) if must_quote(x) else x
        if x is None:
            return "null"
        return number(x) if isinstance(x, (bool, int, float)) else "[]" if isinstance(x, list) else "{}"

    if isinstance(v, list) and v:
        return "\n".join(f"{pad}- {to_yaml(x, level + 1)[len(pad) + 2 :]}" if isinstance(x, (list, dict)) and x else f"{pad}- {bare(x)}" for x in v)
    if isinstance(v, dict) and v:
        return "\n".join(f"{pad}{bare(k)}:\n{to_yaml(v[k], level + 1)}" if isinstance(v[k], (list, dict)) and v[k] else f"{pad}{bare(k)}: {bare(v[k])}" for k in own_order(list(v)))
    return pad + bare(v)


def yaml_scalar(raw: str) -> Any:
    s = raw.strip()
    named = {"": None, "~": None, "null": None, "true": True, "false": False}
    if s in named:
        return named[s]
    if INT.fullmatch(s) and abs(int(s)) <= SAFE:
        return int(s)
    if FLOAT.fullmatch(s):
        return float(s)
    if s[0] == s[-1] and s[0] in "\"'":
        if s[0] == "'":
            return s[1:-1].replace("''", "'")
        try:
            return parse_json(s)
        except ValueError:
            return s[1:-1]
    if s[0] in "[{":
        try:
            return parse_json(s)
        except ValueError:
            return s
    return s


class YamlReader:
    """Reads lines (indent, text) of a document by recursive descent. Comments go as lines are looked at, so that
    the lines of a block scalar, which are taken whole, keep theirs."""

    def __init__(self, text: str):
        self.lines = [x.rstrip() for x in re.split(r"\r?\n", text)]
        self.at = 0

    @staticmethod
    def uncommented(line: str) -> str:
        """Without a comment: a # at the start or after a blank, outside quotes. A quote opens only where a value may start."""
        quote, may_open, depth, i = "", True, 0, 0
        while i < len(line):
            c, after = line[i], line[i + 1 : i + 2]
            ends = not after or after.isspace()
            if quote:
                if c == "\\" and quote == '"' or c == "'" == quote == after:
                    i += 1
                elif c == quote:
                    quote, may_open = "", False
            elif c == "#" and (i == 0 or line[i - 1].isspace()):
                return line[:i].rstrip()
            elif c in "\"'":
                quote, may_open = (c, may_open) if may_open else ("", False)
            elif c == ":" and ends or c in "[{" or c == "," and depth:
                depth, may_open = depth + (c in "[{"), True
            elif c in "]}" and depth:
                depth, may_open = depth - 1, False
            elif not (c.isspace() or c == "-" and may_open and ends):
                may_open = False
            i += 1
        return line

    def peek(self) -> tuple[int, str] | None:
        """Indent and text of the next line that is neither blank nor a comment."""
        while self.at < len(self.lines):
            line = self.uncommented(self.lines[self.at])
            if line.strip():
                return len(line) - len(line.lstrip()), line.strip()
            self.at += 1
        return None

    @staticmethod
    def key_of(text: str) -> tuple[str, str] | None:
        """Key and rest of a mapping's line, or None."""
        if text[:1] in ("'", '"'):
            m = re.match(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*')\s*:""", text)
            return (str(yaml_scalar(m[1])), text[m.end() :]) if m else None
        key, colon, rest = text.partition(":")
        return (key.strip(), rest.lstrip()) if key and colon else None

    @staticmethod
    def block_header(text: str) -> tuple[str, int, bool] | None:
        """Style, stated indent (0: none) and whether the last line feed goes, of what announces a block scalar: a bar or
        an angle, then an indent with a sign before or after it, either or none."""
        style, marks = text[:1], text[1:]
        indent = marks.strip("+-")
        before, after = marks.split(indent, 1) if indent else (marks[:1], marks[1:])
        if style not in ("|", ">") or indent and not indent.isdecimal() or max(len(before), len(after)) > 1:
            return None
        return style, int(indent or 0), "-" in before + after

    def block_scalar(self, header: tuple[str, int, bool], floor: int) -> str:
        style, stated, bare = header
        width, body = floor - 1 + stated if stated else None, []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            indent = len(line) - len(line.lstrip())
            if line and (indent < floor or width is not None and indent < width):
                break
            if line and width is None:
                width = indent
            body.append(line[width:] if line else "")
            self.at += 1
        while body and not body[-1]:
            body.pop()
        while body and not body[0]:
            body.pop(0)
        if not body:
            return ""
        text = body[0]
        for before, line in zip(body, body[1:], strict=False):
            text += ("\n" if style == "|" or not line or not before else " ") + line
        return text if bare else text + "\n"

    def value(self, rest: str, floor: int) -> Any:
        """What follows a key or dash on its line. The line is already taken."""
        header = self.block_header(rest.strip())
        return self.block_scalar(header, floor) if header else yaml_scalar(rest)

    def block(self, least: int, depth: int) -> Any:
        if depth > MAX_DEPTH:
            raise ValueError(DEEP)
        seen = self.peek()
        if seen is None:
            return None
        if DASH.match(seen[1]):
            return self.sequence(least, depth)
        if depth == 0 and self.key_of(seen[1]) is None:
            self.at += 1
            return self.value(seen[1], seen[0] + 1)
        return self.mapping(least, depth, {})

    def sequence(self, least: int, depth: int) -> list:
        items, column = [], None
        while (seen := self.peek()) and seen[0] >= least and DASH.match(seen[1]) and (column is None or seen[0] == column):
            column, rest = seen[0], seen[1][1:]
            inner = column + 1 + len(rest) - len(rest.lstrip())
            rest = rest.strip()
            if not rest:
                self.at += 1
                items.append(self.block(column + 1, depth + 1))
            elif DASH.match(rest) or (rest[0] not in "[{" and self.key_of(rest) and (rest[0] in "\"'" or re.match(r"[^:]*:(\s|$)", rest))):
                # the line's rest is the first line of what is inside
                self.lines[self.at] = " " * inner + rest
                items.append(self.block(inner, depth + 1))
            else:
                self.at += 1
                items.append(self.value(rest, column + 2))
        return items

    def mapping(self, least: int, depth: int, into: dict) -> dict:
        column = None
        while (seen := self.peek()) and seen[0] >= least and (column is None or seen[0] == column) and not DASH.match(seen[1]):
            found = self.key_of(seen[1])
            self.at += 1
            if not found:
                continue
            column, (key, rest) = seen[0], found
            if rest.strip():
                value = self.value(rest, column + 1)
            else:
                below = self.peek()
                same = below is not None and below[0] == column and DASH.match(below[1])
                value = self.block(column if same else column + 1, depth + 1) if below and (same or below[0] > column) else None
            if key not in RESERVED:
                into[key] = value
        return into


def parse_yaml(text: str) -> Any:
    return YamlReader(text).block(0, 0)


# ---------- CSV ----------


def parse_csv(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of cells. A quote opens only at a cell's start; what follows the closing one is appended; blank lines are no rows."""
    text = text.removeprefix("\ufeff")
    d = re.escape(delimiter[:1])
    cell = re.compile(rf'(?:"((?:[^"]|"")*)(?:"|\Z))?([^{d}\r\n]*)({d}|\r\n|\r|\n|\Z)')
    rows, row, at = [], [], 0
    while at < len(text) or row:
        m = cell.match(text, at)
        quoted = m[1] is not None
        row.append((m[1] or "").replace('""', '"') + m[2])
        at = m.end()
        if m[3] != delimiter[:1]:
            if quoted or row != [""]:
                rows.append(row)
            row = []
            if not m[3]:
                break
    return rows


def csv_rows(text: str, delimiter: str = ",") -> list[dict[str, str]]:
    """By the first row's names; a name that is taken gets the next free number; missing cells are empty, further ones dropped."""
    rows = parse_csv(text, delimiter)
    if not rows:
        return []
    names: list[str] = []
    for name in rows[0]:
        new, n = name, 2
        while new in names:
            new, n = f"{name}_{n}", n + 1
        names.append(new)
    return [dict(zip(names, row + [""] * len(names), strict=False)) for row in rows[1:]]


def to_csv(items: list, delimiter: str = ",") -> str:
    """A row for each item; fields in order of first appearance; texts that a spreadsheet would run are disarmed by '."""
    d = delimiter[:1] or ","
    rows = [x if isinstance(x, dict) else {"value": x} for x in items]
    names = list(dict.fromkeys(k for r in rows for k in own_order(list(r))))

    def cell(v: Any) -> str:
        if v is None:
            return ""
        s = v if isinstance(v, str) else to_json(v)
        if isinstance(v, str) and s[:1] in ("=", "+", "-", "@", "\t", "\r") and s:
            s = "'" + s
        return '"' + s.replace('"', '""') + '"' if any(c in s for c in (d, '"', "\r", "\n")) else s

    return "\n".join(d.join(map(cell, line)) for line in [names, *([r.get(n) for n in names] for r in rows)])


# ---------- XML ----------

# Named entities.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
#: Attributes that say what XML alone can't: an array of none or one, null, an array within an array. They start with
#: a digit, so no element or attribute of a document has such a name.
EMPTY, SINGLE, NULL, NESTED = "0-empty", "0-single", "0-null", "0-nested"


def decode_entities(s: str) -> str:
    """Each reference once; unknown ones and numbers that are no character stay."""

    def one(m: re.Match) -> str:
        name = m[1].lower()
        if name[0] != "#":
            return ENTITIES.get(name, m[0])
        code = int(name[2:], 16) if name[1] == "x" else int(name[1:])
        return chr(code) if code <= 0x10FFFF else m[0]

    return re.sub(r"&(#[xX][0-9A-Fa-f]+|#[0-9]+|[A-Za-z]+);", one, s)


def encode_entities(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def xml_name(k: str) -> str:
    """k as a legal name, differently for each k: other characters, and _ itself, as _hex_, and _ before what is no letter."""
    safe = re.sub(r"[^A-Za-z0-9.-]", lambda m: f"_{ord(m[0]):x}_", k)
    return safe if re.match("[A-Za-z]", safe) else "_" + safe


def to_xml(v: Any, name: str = "root", level: int = 0, marks: str = "") -> str:
    """Keys that start with @ are attributes, #text is text; names of elements are escaped twice. marks: attributes of
    the element of the value itself."""
    if level > MAX_DEPTH:
        raise ValueError(DEEP)
    tag = xml_name(name)
    if isinstance(v, list):
        if not v:
            return f'<{tag}{marks} {EMPTY}="true"/>'
        own = marks + (f' {SINGLE}="true"' if len(v) == 1 else "")
        nested = f'{own} {NESTED}="true"'
        return "".join((f'<{tag}{nested}>{to_xml(x, "item", level + 1)}</{tag}>' if x else f'<{tag}{nested} {EMPTY}="true"/>') if isinstance(x, list) else to_xml(x, name, level + 1, own) for x in v)
    if v is None:
        return f'<{tag}{marks} {NULL}="true"/>'
    if not isinstance(v, dict):
        return f"<{tag}{marks}>{encode_entities(_plain(v))}</{tag}>"
    keys = own_order(list(v))
    attributes = "".join(f' {xml_name(k[1:])}="{encode_entities(_plain(v[k])).replace(chr(34), "&quot;")}"' for k in keys if k[:1] == "@")
    inner = "".join(encode_entities(_plain(v[k])) if k == "#text" else to_xml(v[k], xml_name(k), level + 1) for k in keys if k[:1] != "@")
    return f"<{tag}{marks}{attributes}>{inner}</{tag}>" if inner or not attributes else f"<{tag}{marks}{attributes}/>"


def _plain(v: Any) -> str:
    return v if isinstance(v, str) else "" if v is None else number(v) if isinstance(v, (bool, int, float)) else to_json(v)


TOKEN = re.compile(r"<!\[CDATA\[(.*?)\]\]>|<(/?)([^\s/>]+)((?:\s+[^\s=/>]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>|([^<]+)", re.S)
ATTRIBUTE = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)


class XmlElement:
    """fields as read so far, and which of them are arrays."""

    def __init__(self, name: str = "", fields: dict | None = None):
        self.name, self.fields, self.arrays = name, fields or {}, set()

    def add(self, child: XmlElement) -> None:
        own = child.fields
        single, nested, empty, null = (own.get("@" + m) == "true" for m in (SINGLE, NESTED, EMPTY, NULL))
        own = {k: v for k, v in own.items() if not (v == "true" and k in ("@" + SINGLE, "@" + NESTED))}
        if nested:
            inner = own.get("item", [])
            value: Any = [] if empty else inner if "item" in child.arrays else [inner]
        elif empty and len(own) == 1:
            value = []
        elif null and len(own) == 1:
            value = None
        else:
            value = own["#text"] if list(own) == ["#text"] else own or ""
        if child.name in RESERVED:
            return
        if child.name in self.arrays:
            self.fields[child.name].append(value)
        elif child.name in self.fields or single:
            self.fields[child.name] = [*([self.fields[child.name]] if child.name in self.fields else []), value]
            self.arrays.add(child.name)
        else:
            self.fields[child.name] = value


def parse_xml(xml: str) -> Any:
    """The document element by its name. Attributes are @name, text is #text, repeated elements are arrays, an element of text alone is that text."""
    xml = re.sub(r"<\?.*?\?>|<!--.*?-->|<!DOCTYPE(?:[^\[>]|\[.*?\])*>", "", xml, flags=re.S)
    stack, at = [XmlElement()], 0
    while at < len(xml):
        m = TOKEN.match(xml, at)
        if not m:
            raise ValueError(f"XML: unterminated markup at {at}")
        at = m.end()
        top = stack[-1]
        if m[1] is not None or m[6] is not None:
            text = m[1] if m[1] is not None else decode_entities(m[6].strip())
            if text:
                top.fields["#text"] = top.fields.get("#text", "") + text
        elif m[2]:
            if len(stack) == 1 or top.name != m[3]:
                raise ValueError(f"XML: </{m[3]}> closes <{top.name}>")
            stack.pop()
            stack[-1].add(top)
        else:
            made = XmlElement(m[3], {"@" + k: decode_entities(a or b) for k, a, b in ATTRIBUTE.findall(m[4] or "") if k not in RESERVED})
            if m[5]:
                top.add(made)
            elif len(stack) > MAX_DEPTH:
                raise ValueError(DEEP)
            else:
                stack.append(made)
    if len(stack) > 1:
        raise ValueError(f"XML: <{stack[-1].name}> is not closed")
    root = stack[0].fields
    return root["#text"] if list(root) == ["#text"] else root


# ---------- HTML and Markdown ----------

BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "ul", "ol", "p"}
DROPPED = {"script", "style"}


class HtmlNode:
    __slots__ = ("children", "href", "tag")

    def __init__(self, tag: str, href: str | None = None):
        self.tag, self.href, self.children = tag, href, []


class HtmlTree(HTMLParser):
    """Elements that mean something in Markdown; the others' text stays where it is."""

    KEPT = BLOCKS | {"li", "a", "b", "strong", "i", "em", "code", "br"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.root = HtmlNode("")
        self.open, self.dropping = [self.root], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.dropping += 1
        elif tag in self.KEPT and not self.dropping:
            if tag in BLOCKS and self.open[-1].tag == "p":
                self.open.pop()
            node = HtmlNode(tag, dict(attrs).get("href"))
            self.open[-1].children.append(node)
            if tag != "br":
                self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.dropping = max(0, self.dropping - 1)
        elif any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.open[-1].children.append(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


def raw_text(node: HtmlNode | str) -> str:
    return node if isinstance(node, str) else "".join(map(raw_text, node.children))


def squeezed(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def longest_ticks(s: str) -> int:
    return max(map(len, re.findall("`+", s)), default=0)


def inline(parts: list) -> str:
    """Inline Markdown; entities are still as they are."""
    out = ""
    for p in parts:
        if isinstance(p, str):
            out += p
        elif p.tag == "br":
            out += "\n"
        elif p.tag == "a" and p.href is not None:
            out += f"[{squeezed(raw_text(p))}]({p.href})"
        elif p.tag in ("b", "strong", "i", "em"):
            mark = "**" if p.tag in ("b", "strong") else "*"
            out += mark + squeezed(raw_text(p)) + mark
        elif p.tag == "code":
            s = squeezed(raw_text(p))
            ticks, pad = "`" * (longest_ticks(s) + 1), " " if not s or "`" in (s[0], s[-1]) else ""
            out += ticks + pad + s + pad + ticks
        else:
            out += inline(p.children)
    return out


def finished(s: str) -> str:
    return re.sub(r"[ \t]+", " ", decode_entities(s)).strip()


def list_lines(node: HtmlNode, indent: str = "") -> Iterator[str]:
    n = 0
    for item in node.children:
        if isinstance(item, str) or item.tag != "li":
            continue
        n += 1
        inner = [c for c in item.children if isinstance(c, str) or c.tag not in ("ul", "ol")]
        yield f"{indent}{f'{n}.' if node.tag == 'ol' else '-'} {finished(inline(inner))}"
        for c in item.children:
            if not isinstance(c, str) and c.tag in ("ul", "ol"):
                yield from list_lines(c, indent + "  ")


def quote_lines(node: HtmlNode) -> Iterator[str]:
    held: list = []

    def flush() -> Iterator[str]:
        text = finished(inline(held))
        held.clear()
        if text:
            yield from text.split("\n")

    for c in node.children:
        if not isinstance(c, str) and c.tag == "blockquote":
            yield from flush()
            yield from (f"> {x}".rstrip() for x in quote_lines(c))
        else:
            held.append(c)
    yield from flush()


def html_to_markdown(html: str) -> str:
    tree = HtmlTree()
    tree.feed(html.replace("\x00", ""))
    tree.close()
    blocks: list[str] = []
    loose: list = []

    def flush() -> None:
        blocks.extend(re.split(r"\n{2,}", finished(inline(loose))))
        loose.clear()

    def walk(node: HtmlNode) -> None:
        for c in node.children:
            if isinstance(c, str) or c.tag not in BLOCKS:
                loose.append(c)
                continue
            flush()
            if c.tag[0] == "h":
                blocks.append("#" * int(c.tag[1]) + " " + finished(inline(c.children)))
            elif c.tag == "pre":
                text = decode_entities(squeezed(raw_text(c)))
                fence = "`" * max(3, longest_ticks(text) + 1)
                blocks.append(f"{fence}\n{text}\n{fence}")
            elif c.tag == "blockquote":
                blocks.append("\n".join(f"> {x}".rstrip() for x in quote_lines(c)))
            elif c.tag == "p":
                blocks.extend(re.split(r"\n{2,}", finished(inline(c.children))))
            else:
                blocks.append("\n".join(list_lines(c)))
        flush()

    walk(tree.root)
    return "\n\n".join(b.strip() for b in blocks if b.strip())


SAFE_SCHEMES = ("http", "https", "mailto", "tel")


def safe_url(raw: str) -> str:
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", re.sub(r"[\x00-\x20]+", "", raw))
    return "#" if m and m[1].lower() not in SAFE_SCHEMES else raw.strip().replace('"', "&quot;")


def safe_url_column(url: Column) -> Column:
    """safe_url without Python."""
    scheme = F.lower(F.regexp_extract(F.regexp_replace(url, r"[\x00-\x20]+", ""), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when((scheme != "") & ~scheme.isin(*SAFE_SCHEMES), F.lit("#")).otherwise(F.replace(F.trim(url), F.lit('"'), F.lit("&quot;")))


def inline_html(text: str) -> str:
    """Inline Markdown to HTML. Code and link targets are set aside so that emphasis can't touch them."""
    aside: list[str] = []

    def put(s: str) -> str:
        aside.append(s)
        return f"\x00{len(aside) - 1}\x00"

    s = re.sub("`([^`]+)`", lambda m: put(f"<code>{m[1]}</code>"), encode_entities(text.replace("\x00", "")))
    out, at = "", 0
    while (start := s.find("[", at)) >= 0:
        close = s.find("]", start)
        end = _closing(s, close + 1) if close >= 0 and s[close + 1 : close + 2] == "(" else -1
        if end < 0:
            out, at = out + s[at : start + 1], start + 1
            continue
        out += f'{s[at:start]}<a href="{put(safe_url(s[close + 2 : end]))}">{s[start + 1 : close]}</a>'
        at = end + 1
    out += s[at:]
    for mark, tag in ((r"\*\*([^<>]+?)\*\*", "strong"), (r"__([^<>]+?)__", "strong"), (r"\*([^*<>]+)\*", "em"), (r"_([^_<>]+)_", "em")):
        out = re.sub(mark, rf"<{tag}>\1</{tag}>", out)
    return re.sub("\x00([0-9]+)\x00", lambda m: aside[int(m[1])], out)


def _closing(s: str, at: int) -> int:
    """Where the parenthesis that opens at at is closed, or -1."""
    depth = 0
    for i in range(at, len(s)):
        depth += (s[i] == "(") - (s[i] == ")")
        if not depth:
            return i
    return -1


# Kinds of lines, in order of precedence, with what of a line belongs to the block.
QUOTE, BULLET, NUMBERED, HEADING = re.compile(r"\s*>\s?"), re.compile(r"\s*[-*+]\s+"), re.compile(r"\s*\d+[.)]\s+", re.A), re.compile(r"(#{1,6})\s+(.*)")


def markdown_to_html(md: str) -> str:
    lines = re.sub(r"\r\n?", "\n", md).split("\n")
    out, at = [], 0

    def run(kind: re.Pattern) -> list[str]:
        nonlocal at
        taken = []
        while at < len(lines) and (m := kind.match(lines[at])):
            taken.append(lines[at][m.end() :])
            at += 1
        return taken

    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
        elif line.startswith("```"):
            end = next((i for i in range(at + 1, len(lines)) if re.fullmatch(r"```\s*", lines[i])), len(lines))
            out.append(f"<pre><code>{encode_entities(chr(10).join(lines[at + 1 : end]))}</code></pre>")
            at = end + 1
        elif m := HEADING.fullmatch(line):
            out.append(f"<h{len(m[1])}>{inline_html(m[2].strip())}</h{len(m[1])}>")
            at += 1
        elif QUOTE.match(line):
            out.append(f"<blockquote>{inline_html(' '.join(run(QUOTE)).strip())}</blockquote>")
        elif BULLET.match(line) or NUMBERED.match(line):
            kind, tag = (BULLET, "ul") if BULLET.match(line) else (NUMBERED, "ol")
            out.append(f"<{tag}>{''.join(f'<li>{inline_html(x)}</li>' for x in run(kind))}</{tag}>")
        else:
            start = at
            while at < len(lines) and lines[at].strip() and (at == start or not (lines[at].startswith("```") or any(k.match(lines[at]) for k in (HEADING, QUOTE, BULLET, NUMBERED)))):
                at += 1
            out.append(f"<p>{inline_html(' '.join(lines[start:at]))}</p>")
    return "\n".join(out)


# ---------- any to any ----------


def detect_format(s: str) -> str:
    t = s.strip()
    if not t or t[0] in "{[":
        return "json"
    if t[0] == "<":
        return "xml"
    if re.search(r"^\s*[\w.-]+\s*:(\s|$)|^\s*-\s", t, re.M | re.A):
        return "yaml"
    try:
        parse_json(t)
        return "json"
    except ValueError:
        return "csv" if "," in t.split("\n", 1)[0] else "yaml"


def detect_format_column(text: Column) -> Column:
    """detect_format without Python."""
    t = F.regexp_replace(text, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")
    scalar = F.regexp_like(t, F.lit(r'^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")$'))
    return (
        F.when((t == "") | F.substring(t, 1, 1).isin("{", "["), F.lit("json")).when(F.startswith(t, F.lit("<")), F.lit("xml"))
        .when(F.regexp_like(t, F.lit(r"(?m)^\s*[A-Za-z0-9_.-]+\s*:(\s|$)|^\s*-\s")), F.lit("yaml")).when(scalar, F.lit("json"))
        .when(F.contains(F.substring_index(t, "\n", 1), F.lit(",")), F.lit("csv")).otherwise(F.lit("yaml"))
    )


def convert(data: str, source: str, target: str, delimiter: str = ",") -> str:
    """data in another format. source may be auto (json, yaml, csv or xml)."""
    if len(data) > MAX_INPUT:
        raise ValueError(f"transform input is larger than {MAX_INPUT} bytes")
    if {source, target} & {"markdown", "html"}:
        if (source, target) == ("html", "markdown"):
            return html_to_markdown(data)
        if (source, target) == ("markdown", "html"):
            return markdown_to_html(data)
        raise ValueError("markdown and html are only made of each other")
    if source == "auto":
        if not data.strip():
            raise ValueError("no format can be told of an empty text")
        source = detect_format(data)
    v = {"json": parse_json, "yaml": parse_yaml, "xml": parse_xml, "csv": lambda s: csv_rows(s, delimiter)}[source](data)
    if target == "json":
        return to_json(v, 2)
    if target == "yaml":
        return to_yaml(v)
    if target == "csv":
        return to_csv(v if isinstance(v, list) else [v], delimiter)
    return to_xml({"item": v} if isinstance(v, list) else v)


OUTCOME = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])


def converted(data: Column, source: str, target: str, delimiter: str = ",") -> Column:
    """convert as a Column of ok, value, error: a row that fails keeps its error and harms no other. Null is null."""

    @F.pandas_udf(OUTCOME)
    def run(texts: pd.Series) -> pd.DataFrame:
        def one(t: str | None) -> tuple:
            if t is None:
                return (None, None, None)
            try:
                return (True, convert(t, source, target, delimiter), None)
            except (ValueError, RecursionError) as e:
                return (False, None, str(e))

        return pd.DataFrame([one(t) for t in texts], columns=["ok", "value", "error"])

    return run(data)


def csv_cell(v: Column, delimiter: str = ",") -> Column:
    """A text as a CSV cell, without Python."""
    s = F.when(F.regexp_like(v, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), v)).otherwise(v)
    quote = F.contains(s, F.lit(delimiter)) | F.regexp_like(s, F.lit('["\r\n]'))
    return F.coalesce(F.when(quote, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s), F.lit(""))


def xml_text(v: Column) -> Column:
    return F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
