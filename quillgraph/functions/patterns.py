"""Reading Cypher pattern text that need not be a valid query: what a model wrote, or a training row.

Text becomes a tree of brackets once, and everything else is a walk over that tree. The tree keeps all characters, so
parts print as they were. Unbalanced text has no tree and no pattern. The scanners run as Arrow UDFs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_PIECE = re.compile(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|\w+|\s+|.", re.S)
_PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Words that begin a clause, alone or before a second word.
CLAUSES = frozenset("MATCH WHERE RETURN WITH CREATE MERGE SET DELETE REMOVE LIMIT SKIP UNION UNWIND CALL FOREACH".split())
TWO_WORDS = {"OPTIONAL": "MATCH", "ORDER": "BY", "DETACH": "DELETE"}

_TEXT = T.StringType()
PARSED = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("alias", _TEXT), T.StructField("label", _TEXT)]))),
        T.StructField("rels", T.ArrayType(T.StructType([*(T.StructField(n, _TEXT) for n in ("src", "type", "tgt", "direction")), T.StructField("active", T.BooleanType())]))),
        T.StructField("ok", T.BooleanType()),
    ]
)


@dataclass
class Group:
    opening: str
    items: list

    def __str__(self) -> str:
        return self.opening + text_of(self.items) + _PAIRS[self.opening]


def text_of(items: list) -> str:
    return "".join(str(i) for i in items)


def tree(text: str) -> list:
    """Nested brackets of a text; ValueError if they do not match."""
    stack: list[tuple[str, list]] = [("", [])]
    for m in _PIECE.finditer(text):
        piece = m[0]
        if piece in _PAIRS:
            stack.append((piece, []))
        elif piece in ")]}":
            opening, items = stack.pop()
            if not opening or _PAIRS[opening] != piece:
                raise ValueError("a bracket has no partner")
            stack[-1][1].append(Group(opening, items))
        elif piece in "'\"":
            raise ValueError("unterminated string")
        else:
            stack[-1][1].append(piece)
    if len(stack) > 1:
        raise ValueError("a bracket has no partner")
    return stack[0][1]


def split(items: list, at: str) -> list[list]:
    """Runs of items between top-level occurrences of a character."""
    out: list[list] = [[]]
    for i in items:
        if i == at:
            out.append([])
        else:
            out[-1].append(i)
    return out


def _group(items: list, opening: str) -> tuple[list, Group | None]:
    """What stands before the first group with that bracket, and the group."""
    for n, i in enumerate(items):
        if isinstance(i, Group) and i.opening == opening:
            return items[:n], i
    return items, None


def entries(group: Group | None) -> list[tuple[str, str]]:
    """(name, value text) of a property map; a bare name has an empty value."""
    out = []
    for part in split(group.items, ",") if group else []:
        name, *value = split(part, ":")
        if text_of(part).strip():
            out.append((text_of(name).strip(), ":".join(text_of(v) for v in value).strip()))
    return out


def segments(items: list) -> list[tuple[bool, object]]:
    """A path as (True, node group) and (False, connector items) in order; blanks between them are dropped."""
    out: list[tuple[bool, object]] = []
    for i in items:
        if isinstance(i, Group) and i.opening == "(":
            out.append((True, i))
        elif out and not out[-1][0]:
            out[-1][1].append(i)
        elif not (isinstance(i, str) and i.isspace()):
            out.append((False, [i]))
    return out


def match_bodies(items: list) -> list[list]:
    """The items of each MATCH or OPTIONAL MATCH clause."""
    words = [i for i in items if not (isinstance(i, str) and i.isspace())]
    out: list[list] = []
    taking = False
    skip = at = 0
    for i in items:
        blank = isinstance(i, str) and i.isspace()
        if skip and not blank:
            skip, at = 0, at + 1
            continue
        up = i.upper() if isinstance(i, str) else ""
        following = words[at + 1].upper() if not blank and at + 1 < len(words) and isinstance(words[at + 1], str) else ""
        at += not blank
        if up in CLAUSES or TWO_WORDS.get(up) == following and following:
            taking = "MATCH" in (up, following if up == "OPTIONAL" else "")
            skip = up not in CLAUSES
            if taking:
                out.append([])
        elif taking:
            out[-1].append(i)
    return out


def _is_bool(value: str) -> bool:
    return value.lower() in ("true", "false")


def _pattern_node(node: Group) -> str:
    before, props = _group(node.items, "{")
    kept = [f"{k}:{v.lower()}" for k, v in entries(props) if _is_bool(v)]
    return "(" + text_of(before).strip() + (f" {{{', '.join(kept)}}}" if kept else "") + ")"


def _pattern_rel(items: list) -> str:
    whole = text_of(items).strip()
    left, right = "<-" if whole.startswith("<") else "-", "->" if whole.endswith(">") else "-"
    _, box = _group(items, "[")
    if box is None:
        return left + right
    before, props = _group(box.items, "{")
    kept = [f"{k}:{v.lower()}" if _is_bool(v) else k for k, v in entries(props)]
    return f"{left}[{text_of(before).strip()}{' {' + ', '.join(kept) + '}' if kept else ''}]{right}"


def schema_pattern(cypher: str | None) -> str | None:
    """The MATCH patterns of a query without entity values, or None if there is none.

    Relationship maps keep all names, node maps only booleans; paths of a clause are joined by ', ', clauses by a
    newline. Never raises.
    """
    try:
        clauses = []
        for body in match_bodies(tree(cypher or "")):
            paths = ["".join(_pattern_node(x) if node else _pattern_rel(x) for node, x in segments(p)) for p in split(body, ",") if text_of(p).strip()]
            if paths:
                clauses.append(", ".join(paths))
        return "\n".join(c for c in clauses if c).strip() or None
    except ValueError:
        return None


def parse_pattern(text: str | None) -> dict:
    """Nodes and relationships of a pattern; ok is False if it has no tree. A connector without a target is dropped."""
    nodes, rels, fresh = [], [], 0
    try:
        for path in split(tree(text or ""), ","):
            before = waiting = None
            for is_node, x in segments(path):
                if not is_node:
                    waiting = x
                    continue
                head, _ = _group(x.items, "{")
                alias, *label = split(head, ":")
                alias, label = text_of(alias).strip(), ":".join(text_of(v) for v in label).strip() or None
                if not alias:
                    alias, fresh = f"_n{fresh}", fresh + 1
                nodes.append({"alias": alias, "label": label})
                if waiting is not None and before is not None:
                    rels.append(_parsed_rel(before, waiting, alias))
                before, waiting = alias, None
    except ValueError:
        return {"nodes": [], "rels": [], "ok": False}
    return {"nodes": nodes, "rels": rels, "ok": bool(nodes or rels)}


def _parsed_rel(src: str, items: list, tgt: str) -> dict:
    whole = text_of(items).strip()
    direction = "->" if whole.endswith(">") else "<-" if whole.startswith("<") else "--"
    _, box = _group(items, "[")
    head, props = _group(box.items, "{") if box else ([], None)
    kind = [text_of(v) for v in split(head, ":")][1:]
    return {"src": src, "type": ":".join(kind).strip() or None, "tgt": tgt, "direction": direction, "active": any(k.lower() == "active" for k, _ in entries(props))}


def json_object(text: str | None) -> str | None:
    """The first balanced JSON object of a text, code fences removed; None if there is none or it does not parse."""
    import json

    body = (text or "").replace("```json", "").replace("```", "")
    start = body.find("{")
    if start < 0:
        return None
    depth, at = 0, start
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|[{}]|"', body[start:], re.S):
        if m[0] == '"':
            return None
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            at = start + m.end()
            break
    try:
        found = json.loads(body[start:at])
    except ValueError:
        return None
    return body[start:at] if isinstance(found, dict) else None


#: Words that a Cypher statement can begin with.
STARTS = ("MATCH", "OPTIONAL", "RETURN", "CALL", "MERGE", "CREATE", "WITH", "UNWIND")


def clean_cypher(text: Column | str) -> Column:
    """The statement inside a completion, by DataFrame functions: a fenced block if there is one, and of it the lines
    from the first that begins with a clause to the next blank one. Escaped line ends and tabs count as such.

    Lines are dealt to one of three places as they come: before the statement, in it, or after it. Without a clause the
    whole text is taken.
    """
    text = F.col(text) if isinstance(text, str) else text
    plain = F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\r"), F.lit(""))
    # text, fence, text, fence, ...: the second part is the first block, if a further fence ends it
    parts = F.split(plain, "```")
    block = F.regexp_replace(F.try_element_at(parts, F.lit(2)), "^(?i:cypher)?[ \t]*\n?", "")
    body = F.when(F.size(parts) > 2, block).otherwise(plain)
    blank = lambda row: F.trim(F.translate(row, "\t\r\f\x0b", "    ")) == ""
    opens = lambda row: F.rlike(row, F.lit(rf"(?i)^\s*({'|'.join(STARTS)})"))
    start = F.struct(F.lit(0).alias("place"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, row: Column) -> Column:
        place = F.when((state["place"] == 0) & opens(row), 1).when((state["place"] == 1) & blank(row), 2).otherwise(state["place"])
        return F.struct(place.alias("place"), F.when(place == 1, F.concat(state["kept"], F.array(row))).otherwise(state["kept"]).alias("kept"))

    found = F.aggregate(F.split(body, "\r?\n"), start, step)
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(found["place"] == 0, trimmed(body)).otherwise(trimmed(F.array_join(found["kept"], "\n")))


def _each(texts: pd.Series, scan) -> list:
    """scan of every text, once for each distinct one: questions and queries repeat."""
    codes, distinct = pd.factorize(texts, use_na_sentinel=True)
    known = [scan(t) for t in distinct]
    return [known[k] if k >= 0 else scan(None) for k in codes]


@pandas_udf(_TEXT)
def extract_schema_pattern(cypher: pd.Series) -> pd.Series:
    return pd.Series(_each(cypher, schema_pattern), dtype=object)


@pandas_udf(PARSED)
def parse_schema_pattern(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_each(text, parse_pattern), columns=["nodes", "rels", "ok"])


@pandas_udf(_TEXT)
def extract_json_object(text: pd.Series) -> pd.Series:
    return pd.Series(_each(text, json_object), dtype=object)


def first_line(text: Column | str) -> Column:
    """The first line that is not blank, trimmed; empty if there is none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.coalesce(F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1)), F.lit(""))


def has_relationship_type(pattern: Column | str) -> Column:
    return F.coalesce(F.rlike(pattern, F.lit(r"\[[^\]{]*:")), F.lit(False))


def relationship_types(cypher: Column | str) -> Column:
    """Distinct relationship types of a query, alternatives too, sorted."""
    found = F.regexp_extract_all(cypher, F.lit(r"\[[A-Za-z0-9_]*:([A-Z_]+(?:\|:?[A-Z_]+)*)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda x: F.split(F.replace(x, F.lit(":"), F.lit("")), r"\|")))))


def referenced_names(text: Column | str) -> tuple[Column, Column]:
    """(labels, types) that a pattern or query mentions, distinct and sorted: what follows a colon in round brackets and
    in square ones, alternatives each, back quotes taken off and properties left out."""
    bare = F.regexp_replace(text, r"\{[^}]*\}", "")

    def inside(opening: str) -> Column:
        heads = F.regexp_extract_all(bare, F.lit(rf"{opening}[^()\[\]:]*((?:(?:[:|&]\s*)+`?[A-Za-z_][A-Za-z0-9_ ]*`?\s*)+)"), F.lit(1))
        names = F.flatten(F.transform(heads, lambda h: F.split(h, "[:|&]")))
        return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(F.replace(n, F.lit("`"), F.lit("")))), lambda n: n != "")))

    return inside(r"\("), inside(r"\[")


def relationship_count(pattern: Column | str) -> Column:
    return (F.length(pattern) - F.length(F.replace(pattern, F.lit("["), F.lit("")))).cast("long")


def normalised_pattern(pattern: Column | str) -> Column:
    """A pattern without white space and variable names."""
    return F.regexp_replace(F.regexp_replace(pattern, r"\s+", ""), r"([(\[])[A-Za-z0-9_]+:", "$1:")


def label_of(nodes: Column, alias: Column) -> Column:
    """The label of a variable among the nodes of a parsed pattern, wherever it is given."""
    return F.get(F.filter(nodes, lambda n: (n["alias"] == alias) & n["label"].isNotNull()), 0)["label"]


def signature(parsed: Column) -> Column:
    """A parsed pattern up to direction of writing and names: its relationships from source to target, and lone labels."""
    label = lambda alias: label_of(parsed["nodes"], alias)

    def rel(r: Column) -> Column:
        a, b = label(r["src"]), label(r["tgt"])
        back = r["direction"] == "<-"
        ends = F.concat_ws(">", F.coalesce(F.when(back, b).otherwise(a), F.lit("?")), F.coalesce(r["type"], F.lit("?")), F.coalesce(F.when(back, a).otherwise(b), F.lit("?")))
        return F.concat(ends, F.when(r["active"], "!").otherwise(""))

    touched = F.flatten(F.transform(parsed["rels"], lambda r: F.array(r["src"], r["tgt"])))
    lone = F.filter(parsed["nodes"], lambda n: n["label"].isNotNull() & ~F.array_contains(touched, n["alias"]))
    return F.concat(F.array_join(F.transform(parsed["rels"], rel), ","), F.lit("/"), F.array_join(F.array_sort(F.transform(lone, lambda n: n["label"])), ","))
