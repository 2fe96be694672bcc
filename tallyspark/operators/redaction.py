"""Redaction of records and texts, and the check of what is left (bulk jobs over a column).

User names come from the records themselves (fields that name a user, report columns that hold one) or
from any table of names; each has a stand-in. Names are looked for with one automaton over folded text, not with an
expression per name: in any case, with any white space between their words, and never inside a longer word. Where
finds overlap the longest counts.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.text import ACCESS, EMAIL, REALM, REDACTED_EMAIL, REFRESH, USER_STAND_IN
from tallyspark.plans import staging
from tallyspark.plans.staging import numbered, settle
from tallyspark.sources.accounting import KNOWN_KEYS, TITLE_KEYS

#: Report columns that hold a user, by key.
USER_COLUMNS = ("create_by", "last_mod_by")
_EMAIL = re.compile(EMAIL)
#: Of texts up to this length, what became of this many is kept in a task: keys and codes come again in every document.
SHORT, KEPT_SHORT = 64, 1 << 14


# -- inside tasks ---------------------------------------------------------------------

def fold(text: str) -> str:
    """Text without regard to case and spacing."""
    return " ".join(text.casefold().split())


def _no_emails(text: str) -> str:
    return _EMAIL.sub(REDACTED_EMAIL, text) if "@" in text else text


def _word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _places(text: str) -> tuple[str, list[int]]:
    """``text`` folded with its blanks, and for each letter of that, and its end, the place in ``text``."""
    letters, at = [], []
    for run in re.finditer(r"\s+|\S+", text):
        piece, first = run.group(), run.start()
        if piece.isspace():
            letters.append(" ")
            at.append(first)
            continue
        folded = piece.casefold()
        letters.append(folded)
        if len(folded) == len(piece):
            at.extend(range(first, run.end()))
        else:
            at.extend(first + i for i, c in enumerate(piece) for _ in c.casefold())
    return "".join(letters), [*at, len(text)]


class Names:
    """Names to find; each stands for its folded form, the same for several ways to write it."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        import ahocorasick

        self.found: dict[str, list[str]] = {}
        for name, stand_in in sorted(names, key=lambda n: (-len(n[0]), n[0])):
            if key := fold(name):
                self.found.setdefault(key, []).append(stand_in)
        self.automaton = ahocorasick.Automaton()
        for key in self.found:
            self.automaton.add_word(key, key)
        if self.found:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> Iterator[tuple[int, int, str]]:
        """Start, end and folded name of every find that is no part of a longer word."""
        if not self.found:
            return
        for last, key in self.automaton.iter(folded):
            first, end = last + 1 - len(key), last + 1
            if not (first and _word(folded[first - 1])) and not (end < len(folded) and _word(folded[end])):
                yield first, end, key

    def within(self, folded: str) -> bool:
        """Whether any name is found."""
        return any(True for _ in self.hits(folded))

    def scrub(self, text: str) -> str:
        if not self.within(fold(text)):
            return text
        folded, at = _places(text)
        taken: list[tuple[int, int, str]] = []
        for first, end, key in sorted(self.hits(folded), key=lambda h: (-len(h[2]), h[2], h[0])):
            place = bisect.bisect(taken, (first, end, key))
            if (place == 0 or taken[place - 1][1] <= first) and (place == len(taken) or end <= taken[place][0]):
                taken.insert(place, (first, end, key))
        out, done = [], 0
        for first, end, key in taken:
            out += [text[done:at[first]], self.found[key][0]]
            done = at[end]
        return "".join([*out, text[done:]])


class Walk:
    """A JSON document anew: ``user`` for what names a user, ``text`` for any other text, tokens replaced."""

    def __init__(self, user: Callable[[str], str], text: Callable[[str], str]) -> None:
        self.user, self.text = user, text

    def node(self, node: object) -> object:
        if isinstance(node, dict):
            return self.report(node) if "Columns" in node and "Rows" in node else self.fields(node)
        if isinstance(node, list):
            return [self.node(item) for item in node]
        return self.text(node) if isinstance(node, str) else node

    def fields(self, node: dict) -> dict:
        out = {}
        for key, value in node.items():
            if key == "id_token":
                continue
            if key in ("access_token", "refresh_token"):
                out[key] = ACCESS if key == "access_token" else REFRESH
            elif value and (key.endswith(("By", "ByRef")) or key == "UserName"):
                out[key] = self.reference(value) if isinstance(value, dict) else self.user(str(value))
            else:
                out[key] = self.node(value)
        return out

    def reference(self, node: dict) -> dict:
        return {k: self.user(str(v)) if k in ("value", "name") and v else self.node(v) for k, v in node.items()}

    def report(self, node: dict) -> dict:
        columns = (node["Columns"] or {}).get("Column") or []
        users = {i for i, c in enumerate(columns) if column_key(c) in USER_COLUMNS}
        return {k: self.rows(v, users) if k == "Rows" else self.node(v) for k, v in node.items()}

    def rows(self, node: object, users: set[int]) -> object:
        if isinstance(node, list):
            return [self.rows(item, users) for item in node]
        if not isinstance(node, dict):
            return self.node(node)
        data = node.get("type") != "Section"
        return {k: [self.cell(c, i in users) for i, c in enumerate(v)] if data and k == "ColData" and isinstance(v, list) else self.rows(v, users)
                for k, v in node.items()}

    def cell(self, cell: object, user: bool) -> object:
        if user and isinstance(cell, dict) and cell.get("value"):
            return {**self.fields(cell), "value": self.user(str(cell["value"]))}
        return self.node(cell)


def column_key(column: dict) -> str:
    """The key of a report column: named beside it, else its type where that is a key, else by its title."""
    named = [m["Value"] for m in column.get("MetaData") or [] if isinstance(m, dict) and m.get("Name") == "ColKey" and m.get("Value")]
    if named or column.get("ColType") in KNOWN_KEYS:
        return str(named[0] if named else column["ColType"])
    title = str(column.get("ColTitle") or "")
    return TITLE_KEYS.get(title.strip().lower(), title)


def _renamed(node: object, text: Callable[[str], str], realm_id: str) -> object:
    """Known names and the realm id replaced in every text, key and number; two keys that become one are refused."""
    if isinstance(node, dict):
        out: dict[str, object] = {}
        for key, value in node.items():
            clean = text(key)
            if clean in out:
                raise ValueError(f"two keys scrub to {clean!r}")
            out[clean] = _renamed(value, text, realm_id)
        return out
    if isinstance(node, list):
        return [_renamed(item, text, realm_id) for item in node]
    if isinstance(node, str):
        return text(node)
    return REALM if realm_id and type(node) in (int, float) and str(node) == realm_id else node


# -- over columns ----------------------------------------------------------------------

#: How many bytes of text are taken from Arrow into Python at once; a longer text alone.
SLICE_BYTES = 4 * 1024 * 1024


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts in ``column`` are at most about SLICE_BYTES, so that what a worker holds beside the batch
    does not grow with its rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        held = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, held + SLICE_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def _each(df: DataFrame, column: str, made: dict[str, T.DataType], work: Callable[[], Callable[[str], tuple]]) -> DataFrame:
    """``df`` with the columns ``made`` (older ones give way) from each text of ``column``, null for null;
    ``work`` is called once a task."""
    kept = [f for f in df.schema.fields if f.name not in made]
    schema = T.StructType([*kept, *[T.StructField(name, kind) for name, kind in made.items()]])
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`").alias(staging.unused("_text", df.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, arrow = None, None
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1):
                one = one or work()
                done = [one(t) if t is not None else (None,) * len(made) for t in batch.column(batch.num_columns - 1).to_pylist()]
                arrow = arrow or [pa.string() if isinstance(k, T.StringType) else pa.list_(pa.string()) for k in made.values()]
                new = [pa.array([d[i] for d in done], kind) for i, kind in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    return source.mapInArrow(run, schema).select(*[c for c in df.columns if c in schema.names], *[c for c in made if c not in df.columns])


def record_users(records: DataFrame, column: str) -> DataFrame:
    """``name``: every user that the JSON documents of ``column`` name, numbers as text; by field (ending By or ByRef, or
    UserName; of objects their value and name) or by place in a report. Texts that are no JSON, and null, name none."""
    def work() -> Callable[[str], tuple]:
        def names(document: str) -> tuple:
            found: set[str] = set()
            try:
                Walk(lambda name: found.add(name) or name, lambda text: text).node(json.loads(document))
            except (ValueError, RecursionError):
                pass
            return (sorted(found),)
        return names

    return _each(records.select(column), column, {"names": T.ArrayType(T.StringType())}, work).select(F.explode("names").alias("name")).distinct()


def stand_ins(names: DataFrame) -> DataFrame:
    """A stand-in per name, numbered in name order, the same on every run."""
    return numbered(names, ["name"], "number").select("name", F.concat(F.lit(USER_STAND_IN), F.col("number").cast("string")).alias("stand_in"))


def real_names(names: DataFrame) -> DataFrame:
    """Names (name, stand_in) to look for: not blank and not themselves stand-ins, as in data that was redacted before."""
    told = names.select(F.col("stand_in").alias("name")).distinct()
    return names.where(F.col("name").rlike(r"(?U)\S")).join(told, "name", "left_anti").select("name", "stand_in")


def portions(names: DataFrame) -> list[Column]:
    """Conditions that cut ``names`` (name, settled) into portions of at most about staging.BROADCAST_BYTES, the longest names first, so
    that every portion fits a task and what is replaced first is longest. One portion for any usual table."""
    length = F.length("name")
    sizes = names.groupBy(length.alias("length")).agg(F.sum(2 * F.octet_length("name") + 32).alias("bytes")).orderBy(F.desc("length")).collect()
    out: list[Column] = []
    lengths, held = [], 0
    for row in sizes:
        if lengths and held + row["bytes"] > staging.BROADCAST_BYTES:
            out.append(length.isin(lengths))
            lengths, held = [], 0
        if row["bytes"] > staging.BROADCAST_BYTES:
            parts = -(-row["bytes"] // staging.BROADCAST_BYTES)
            out += [(length == row["length"]) & (F.pmod(F.xxhash64("name"), F.lit(parts)) == p) for p in range(parts)]
        else:
            lengths, held = [*lengths, row["length"]], held + row["bytes"]
    return [*out, length.isin(lengths)] if lengths or not out else out


def _portions(names: DataFrame) -> Iterator[list[tuple[str, str]]]:
    for condition in portions(names):
        yield [(r["name"], r["stand_in"]) for r in names.where(condition).select("name", "stand_in").collect()]


def scrubbed(df: DataFrame, column: str, realm_id: str, names: DataFrame) -> DataFrame:
    """``df`` with the realm id, e-mail addresses and the names (name, stand_in) in the texts of ``column`` replaced. Null stays
    null; an empty table of names or of texts is none."""
    for known in _portions(settle(real_names(names), "names")):
        def work(known: list = known) -> Callable[[str], tuple]:
            find = Names(known)
            return lambda text: (find.scrub(_no_emails(text.replace(realm_id, REALM) if realm_id else text)),)

        df = _each(df, column, {column: T.StringType()}, work)
    return df


def cleaner(known: list[tuple[str, str, bool]], realm_id: str) -> Callable[[str], tuple]:
    """What makes a document safe, or says why it cannot be, by names (name, stand_in, whether to look for it in texts). Texts and keys are
    gone through one by one only where the document, once its fields are done, holds any name or the realm id at all."""
    users, find = {n: s for n, s, _ in known}, Names([(n, s) for n, s, real in known if real])

    def bare(text: str) -> str:
        return text.replace(realm_id, REALM) if realm_id else text

    @functools.lru_cache(KEPT_SHORT)
    def short(text: str) -> str:
        return find.scrub(bare(text))

    def renamed(text: str) -> str:
        return short(text) if len(text) <= SHORT else find.scrub(bare(text))

    def untouched(written: str) -> bool:
        # without escapes every text stands in the document as it is, so that what is not found in it is in none of its texts
        return "\\" not in written and not (realm_id and realm_id.casefold() in written.casefold()) and not find.within(fold(written))

    walk = Walk(lambda name: users.get(name, name), lambda text: _no_emails(bare(text)))

    def clean(document: str) -> tuple:
        try:
            node = json.loads(document)
        except ValueError:
            return find.scrub(walk.text(document)), None
        except RecursionError:
            return None, "nested too deep"
        try:
            node = walk.node(node)
            written = json.dumps(node, ensure_ascii=False, separators=(",", ":"))
            if untouched(written):
                return written, None
            return json.dumps(_renamed(node, renamed, realm_id), ensure_ascii=False, separators=(",", ":")), None
        except (ValueError, RecursionError) as why:
            return None, "nested too deep" if isinstance(why, RecursionError) else str(why)
    return clean


def sanitized(df: DataFrame, column: str, realm_id: str, names: DataFrame | None = None, problem: str = "problem") -> DataFrame:
    """``df`` with the JSON documents of ``column`` safe to keep, and ``problem``, why a document was refused (then it is null).

    Identity tokens go, other tokens are replaced; users that fields or report columns name become their stand-ins, numbers too; e-mail
    addresses, the realm id (as text, number or key) and every known name in any text or key are replaced. ``names`` (name, stand_in) are
    known besides, by default all that the documents name, numbered in name order. A document two of whose keys become one, or that is nested too
    deep to read, is refused. Text that is no JSON is scrubbed as text; null stays null."""
    own = record_users(df, column)
    with staging.small_batches(df.sparkSession):
        own = settle(own, "users")
    if names is None:
        names = stand_ins(own)
    else:  # what the table does not know is numbered after it
        more = numbered(own.join(names, "name", "left_anti"), ["name"], "number").select("name", F.concat(F.lit(f"{USER_STAND_IN}x"), F.col("number").cast("string")).alias("stand_in"))
        names = names.select("name", "stand_in").unionByName(more)
    names = settle(names, "names")
    known_words = settle(real_names(names).select("name", F.lit(True).alias("real")), "real-names")
    marked = settle(names.join(known_words, "name", "left"), "names")
    out = df.withColumn(problem, F.lit(None).cast("string"))
    for condition in portions(marked):
        known = [tuple(r) for r in marked.where(condition).select("name", "stand_in", "real").collect()]

        def work(known: list = known) -> Callable[[str], tuple]:
            return cleaner(known, realm_id)

        before = staging.unused("_before", out.columns)
        done = _each(out.withColumnRenamed(problem, before), column, {column: T.StringType(), problem: T.StringType()}, work)
        out = done.withColumn(problem, F.coalesce(before, problem)).drop(before)
    return out


def leftovers(df: DataFrame, column: str, realm_id: str, names: DataFrame, found: str = "findings") -> DataFrame:
    """``df`` with ``found``: what the texts of ``column`` should no longer hold and do, in order, each once: the realm id
    (inside a longer number too), then users by stand-in. Null for null."""
    out = df.withColumn(found, F.when(F.col(column).isNotNull(), F.array().cast("array<string>")))
    for known in _portions(settle(real_names(names), "names")):
        def work(known: list = known) -> Callable[[str], tuple]:
            find = Names(known)
            return lambda text: (sorted({f"a user name ({s})" for _, _, key in find.hits(fold(text)) for s in find.found[key]}),)

        more = staging.unused("_more", out.columns)
        out = _each(out, column, {more: T.ArrayType(T.StringType())}, work)
        out = out.withColumn(found, F.array_sort(F.array_union(found, more))).drop(more)
    if realm_id:
        out = out.withColumn(found, F.when(F.col(column).contains(realm_id), F.concat(F.array(F.lit("the realm id")), found)).otherwise(F.col(found)))
    return out
