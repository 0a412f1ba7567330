"""The token matcher: case-sensitive, anchored at token starts, a name's tokens separated by a literal \\W.

A token starts at the text's begin and after a run of boundary characters. A name is matched token by token: each of its tokens
has to be a prefix of the text at a token start; blanks between are free, and a name may end inside a word. When a
token fails, matching starts over with the name's first token, one character further; in `compat` mode the
failing place isn't tried as a first token, otherwise it is.

A text is searched once for the first tokens of all names; only names of which one is found are walked, from there on.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.normalize import SPACES
from lexispark.functions.worker import once
from lexispark.operators.annotate import put
from lexispark.plans.config import MatchConfig

#: Blank, LF, TAB and CR; more characters can be registered. Fixed values.
BOUNDARY = " \n\t\r"
UNICODE_BOUNDARY = SPACES


class TokenMatcher:
    def __init__(self, names: list[str], boundary: str = BOUNDARY, compat: bool = False):
        if not names:
            raise ValueError("no names to match")
        self.names = [n.split("\\W") for n in names]
        if any(not t for tokens in self.names for t in tokens):
            raise ValueError("a name has an empty token")
        self.compat, edge = compat, re.escape(boundary)
        self.start = re.compile(f"(?:^|(?<=[{edge}]))[^{edge}]", re.DOTALL)
        self.by_first = defaultdict(list)
        for number, tokens in enumerate(self.names):
            self.by_first[tokens[0]].append(number)
        self.machine = None

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.start.finditer(text)]

    def firsts(self, text: str, starts: list[int]) -> dict[str, list[int]]:
        """Where each first token stands at a token start."""
        if self.machine is None:
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for token in self.by_first:
                self.machine.add_word(token, token)
            self.machine.make_automaton()
        found, at = defaultdict(list), set(starts)
        for end, token in self.machine.iter(text):
            if (begin := end + 1 - len(token)) in at:
                found[token].append(begin)
        return found

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(name number, first, end) of each mention, name by name."""
        starts = self.starts(text)
        return sorted((x for token, at in self.firsts(text, starts).items() for n in self.by_first[token] for x in self.walk(n, text, starts, at)), key=lambda x: x[0])

    def walk(self, number: int, text: str, starts: list[int], at: list[int]):
        """The mentions of one name; at: where its first token stands."""
        tokens, begin = self.names[number], 0
        while (i := bisect_left(at, begin)) < len(at):
            first, failed = at[i], None
            limit = first + len(tokens[0])
            for token in tokens[1:]:
                k = bisect_right(starts, limit)  # a boundary has been passed since the last token
                if k == len(starts):
                    return
                if not text.startswith(token, starts[k]):
                    failed = starts[k]
                    break
                limit = starts[k] + len(token)
            if failed is None:
                yield number, first, limit
                begin = limit + 1
            else:
                begin = failed + self.compat


def matcher(names: list[str], boundary: str, compat: bool) -> TokenMatcher:
    return once(("tokens", tuple(names), boundary, compat), lambda: TokenMatcher(names, boundary, compat))


def collected(name_targets: DataFrame, most: int) -> tuple[list[str], list[list[str]]]:
    """Names and their targets, in order; a dictionary of more bytes is refused before it is collected."""
    rows = name_targets.groupBy("name").agg(F.array_sort(F.collect_list("target_id")).alias("target_ids"))
    size = rows.agg(F.sum(F.octet_length("name") + F.octet_length(F.array_join("target_ids", "")))).first()[0] or 0
    if size > most:
        raise ValueError(f"the dictionary takes {size} bytes, more than {most}; token matching needs it on every worker")
    rows = rows.orderBy("name").collect()
    return [r["name"] for r in rows], [r["target_ids"] for r in rows]


def token_mentions(text: Column, name_targets: DataFrame, boundary: str = BOUNDARY, compat: bool = False, most: int = MatchConfig.max_broadcast) -> Column:
    """The mentions of a text, in order of name and place: array of (name, first, length, target_ids), offsets in characters."""
    names, targets = collected(name_targets, most)
    TokenMatcher(names, boundary, compat)  # raises here if a name is no good

    @F.arrow_udf("array<struct<name:string,first:int,length:int,target_ids:array<string>>>")
    def found(texts):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("name", pa.string()), ("first", pa.int32()), ("length", pa.int32()), ("target_ids", pa.list_(pa.string()))]))
        find = matcher(names, boundary, compat).find
        return pa.array([[{"name": names[i], "first": a, "length": b - a, "target_ids": targets[i]} for i, a, b in find(t or "")] for t in texts.to_pylist()], kind)

    return found(text)


def mentions(docs: DataFrame, name_targets: DataFrame, id_col: str = "doc_id", text: str = "text", boundary: str = BOUNDARY, compat: bool = False) -> DataFrame:
    """(id, name, first, length, target_ids): one row per mention, offsets in characters."""
    found = docs.select(id_col, F.explode_outer(token_mentions(F.col(text), name_targets, boundary, compat)).alias("m"))
    return found.filter("m is not null").select(id_col, "m.*")


def labels(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, target_id, first, length): one label and rating per mention and target, repeats kept."""
    return found.select(id_col, F.explode("target_ids").alias("target_id"), "first", "length")


def with_labels(docs: DataFrame, name_targets: DataFrame, annotator_id: str = MatchConfig.annotator_id, text: str = "text", boundary: str = BOUNDARY, compat: bool = False) -> DataFrame:
    """docs with a label per mention and target appended to the entry of the annotator in the map `labels`, and as many ratings in the
    map `ratings`; both are made if docs has none. Row by row; a document without a mention keeps its maps."""
    annotator = F.struct(F.lit(annotator_id).alias("annotator_id")).alias("annotator")
    target = lambda t: F.struct(t.alias("target_id")).alias("target")
    rows = docs.select(F.struct("*").alias("row"), token_mentions(F.col(text), name_targets, boundary, compat).alias("found"))
    each = lambda make: F.flatten(F.transform("found", lambda m: F.transform(m["target_ids"], lambda t: make(m, t))))
    new = {"labels": each(lambda m, t: F.struct(annotator, target(t), m["first"].alias("first"), m["length"].alias("length"))), "ratings": each(lambda m, t: F.struct(annotator, target(t)))}

    def merged(key: str) -> Column:
        if key not in docs.columns:
            return F.when(F.size(new[key]) > 0, F.create_map(F.lit(annotator_id), new[key]))
        old = F.col("row").getField(key)
        known = F.coalesce(F.try_element_at(old, F.lit(annotator_id)), F.slice(new[key], 1, 0))
        base = F.coalesce(old, F.map_filter(F.create_map(F.lit(annotator_id), new[key]), lambda k, _: k != annotator_id))
        return F.when(F.size(new[key]) > 0, put(base, annotator_id, F.concat(known, new[key]))).otherwise(old)

    out = dict.fromkeys((*docs.columns, *new))
    return rows.select(*[(merged(c) if c in new else F.col("row").getField(c)).alias(c) for c in out])
