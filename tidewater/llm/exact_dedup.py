"""Exact duplicates by Patricia tries over whole byte strings.

Every task first puts its own rows into a trie, so that a text travels once for
each some megabytes of text that hold it, however many rows have it there; the
rows themselves stay behind, as a list beside that text's local number. What
travels is dealt by (length, content hash). Each of these partitions inserts the
full strings into a compressed radix trie below their hash; a terminal node keeps
the owner, the number of rows and the local numbers. A hash only decides where
strings meet, never that they are equal.

A trie that grows over its budget gives up its heaviest subtree: the strings of it,
and all that would go there later, are written to the shared folder as they are and
settled in another round, dealt anew. A round keeps at least one branch of each trie,
so the rounds end; a single string is never given up. Owners return to the rows by
local number, which stands for few rows whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import text as T
from tidewater.llm.storage import materialize, shuffle_partitions

#: A task lays aside its local texts once they have so many bytes, or rows.
LOCAL_BYTES, LOCAL_ROWS = 32 << 20, 200_000
#: Bytes of text for each partition of tries, and those above which a trie gives up a subtree.
PARTITION_BYTES, TRIE_BYTES = 48 << 20, 160 << 20
#: What a node takes beside its label.
NODE_BYTES = 300


class Node:
    """A node of the trie: the bytes on the edge to it, its children by their first byte, and what ends here."""

    __slots__ = ("label", "children", "value", "given_up")

    def __init__(self, label: bytes, value=None):
        self.label, self.value = label, value
        self.children: dict[int, Node] = {}
        self.given_up = False


def common(a: bytes, b: bytes, at: int) -> int:
    """The length of the longest start that ``a`` shares with ``b`` from ``at`` on."""
    most = min(len(a), len(b) - at)
    if b.startswith(a[:most] if most < len(a) else a, at):
        return most
    low, high = 0, most  # the first ``low`` bytes agree, not all of the first ``high``
    while high - low > 1:
        middle = (low + high) >> 1
        if b.startswith(a[low:middle], at + low):
            low = middle
        else:
            high = middle
    return low


class Trie:
    """A compressed radix trie from byte strings to values."""

    def __init__(self):
        self.root = Node(b"")
        self.size = 0

    def find(self, key: bytes, make: Callable):
        """The value at ``key``, made if the key is new; None below a subtree that was given up."""
        node, at = self.root, 0
        while True:
            if node.given_up:
                return None
            if at == len(key):
                if node.value is None:
                    node.value = make()
                return node.value
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:], make())
                self.size += NODE_BYTES + len(child.label)
                return child.value
            n = common(child.label, key, at)
            if n < len(child.label):  # the edge is split; a subtree that was given up stays whole below it
                upper = Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                self.size += NODE_BYTES
                child = upper
            node, at = child, at + n

    def items(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        """All strings below a node, with their values; of an edge and its nodes in order of their bytes."""
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            whole = prefix + node.label
            if node.value is not None:
                yield whole, node.value
            stack.extend((node.children[b], whole) for b in sorted(node.children, reverse=True))

    def give_up(self) -> list[tuple[bytes, object]]:
        """Take out the heaviest subtree below the first branch; empty if there is nothing that can go."""
        node, prefix = self.root, b""
        while True:
            alive = [c for c in node.children.values() if not c.given_up]
            if len(alive) + (node.value is not None) > 1:
                break
            if not alive:
                return []
            prefix, node = prefix + node.label, alive[0]
        weights = {id(c): _weight(c) for c in alive}
        heaviest = max(alive, key=lambda c: (weights[id(c)], c.label))
        taken = list(self.items(heaviest, prefix + node.label))
        self.size -= weights[id(heaviest)] - NODE_BYTES - len(heaviest.label)
        heaviest.children, heaviest.value, heaviest.given_up = {}, None, True
        return taken


def _weight(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        node = stack.pop()
        total += NODE_BYTES + len(node.label)
        stack.extend(node.children.values())
    return total


class Terminal:
    """What ends at a string: the best key and its local text, the rows, and the local texts."""

    __slots__ = ("key", "local", "rows", "locals")

    def __init__(self):
        self.key = self.local = None
        self.rows, self.locals = 0, []

    def add(self, key, local: int, rows: int, largest: bool) -> None:
        before = self.local is None or (key, self.key) != (None, None) and (self.key is None or key is not None and (key > self.key if largest else key < self.key))
        if before or key == self.key and local < self.local:
            self.key, self.local = key, local
        self.rows += rows
        self.locals.append(local)


def packed(h: int) -> bytes:
    """The eight bytes under which a trie keeps the strings of a hash."""
    return h.to_bytes(8, "big", signed=True)


def local_texts(rows: DataFrame, *, key: str, largest: bool, kinds: dict[str, str], most_bytes: int, most_rows: int) -> DataFrame:
    """One row for each text of a task: its number, length, hash, the text, its best key, rows, and these rows without the text, best first."""
    fields = [c for c in rows.columns if c not in ("__body", "__hash")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = 0, TaskContext.get().partitionId() << 33
        trie, held, n, beside = Trie(), [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal trie, held, n, beside, number
            if not n:
                return
            table = pa.concat_tables(held).combine_chunks()
            keys = table.column(key).to_pylist()
            for some in _slices(((k[8:], int.from_bytes(k[:8], "big", signed=True), v) for k, v in trie.items())):
                bodies, hashes, members = zip(*some, strict=True)
                for own in members:
                    own.sort(key=lambda i: (keys[i] is None, 0 if keys[i] is None else keys[i]))
                    if largest:
                        known = sum(keys[i] is not None for i in own)
                        own[:known] = reversed(own[:known])
                taken = table.take(pa.array([i for own in members for i in own], pa.int64())).combine_chunks()
                offsets = [0]
                for own in members:
                    offsets.append(offsets[-1] + len(own))
                inner = pa.StructArray.from_arrays([_flat(taken.column(c)) for c in fields], fields)
                best = table.column(key).take(pa.array([own[0] for own in members], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(task + number, task + number + len(some)), pa.int64()), pa.array([len(b) for b in bodies], pa.int64()), pa.array(hashes, pa.int64()), pa.array(bodies, pa.binary()), _flat(best), pa.array([len(m) for m in members], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)],
                    ["local", "length", "hash", "body", "best", "rows", "members"],
                )
                number += len(some)
            trie, held, n, beside = Trie(), [], 0, 0

        for batch in batches:
            for part in T.small_batches(batch, "__body", 8 << 20):
                for body, h in zip(part.column("__body").cast(pa.binary()).to_pylist(), part.column("__hash").to_pylist(), strict=True):
                    trie.find(packed(h) + body, list).append(n)
                    n += 1
                held.append(part.select(fields))
                beside += held[-1].nbytes
                if max(trie.size, beside) > most_bytes or n > most_rows:
                    yield from flush()
        yield from flush()
        T.release()

    inner = ", ".join(f"`{c}`: {kinds[c]}" for c in fields)
    return rows.mapInArrow(run, f"local long, length long, hash long, body binary, best {kinds[key]}, rows long, members array<struct<{inner}>>")


def _flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _slices(items: Iterator, most: int = 8 << 20) -> Iterator[list]:
    """Lists of strings and their values of about ``most`` bytes."""
    out, size = [], 0
    for x in items:
        out.append(x)
        size += len(x[0]) + 100
        if size > most:
            yield out
            out, size = [], 0
    if out:
        yield out


SETTLED = "local long, keep {key}, winner long, size long, length long, hash long, body binary, rows long"


def settle(texts: DataFrame, *, kind: str, largest: bool, budget: int, partitions: int) -> DataFrame:
    """(local, keep, winner, size) of each local text; one that was given up has a null size, and comes with its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        names = ["local", "keep", "winner", "size", "length", "hash", "body", "rows"]
        arrow = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), arrow, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        def pending(taken: list[tuple[bytes, Terminal]]) -> Iterator[pa.RecordBatch]:
            """One row carries a string on for all local texts that met here; the others point to it."""
            for some in _slices(((k[8:], int.from_bytes(k[:8], "big", signed=True), t) for k, t in taken)):
                rows = []
                for body, h, t in some:
                    rows += [(t.local, t.key, t.local, None, len(body), h, body, t.rows)]
                    rows += [(x, t.key, t.local, None, None, None, None, None) for x in t.locals if x != t.local]
                yield out(rows)

        for batch in batches:
            for part in T.small_batches(batch, "body", 8 << 20):
                arrow = part.schema.field("best").type
                columns = [part.column(c).to_pylist() for c in ("local", "hash", "body", "best", "rows")]
                later = []
                for local, h, body, best, rows in zip(*columns, strict=True):
                    ending = trie.find(packed(h) + body, Terminal)
                    if ending is None:
                        later.append((local, best, local, None, len(body), h, body, rows))
                    else:
                        ending.add(best, local, rows, largest)
                if later:
                    yield out(later)
                while trie.size > budget:
                    taken = trie.give_up()
                    if not taken:
                        break
                    yield from pending(taken)
        for some in _slices(((b"", t) for _, t in trie.items()), 4 << 20):
            yield out([(x, t.key, t.local, t.rows, None, None, None, None) for _, t in some for x in t.locals])
        T.release()

    dealt = texts.select("local", "length", "hash", "body", "best", "rows").repartition(partitions, "length", "hash")
    return dealt.mapInArrow(run, SETTLED.format(key=kind))


def owners(docs: DataFrame, *, text: str = "text", key: str = "doc_id", keep: str = "largest", normal: Callable[[Column], Column] | None = None, hash_bits: int = 64, local_bytes: int = LOCAL_BYTES, local_rows: int = LOCAL_ROWS, budget: int = TRIE_BYTES, rounds: int = 1000) -> DataFrame:
    """``docs`` with columns keep_id, group_size, kept and text_sha256: one row for each row.

    Rows are equal if their texts are, after ``normal`` (by default: as they are);
    a null text counts as empty, and is null in the result as before. ``keep_id`` is
    the ``largest`` (or ``smallest``) key of the group, whose row is ``kept``; of
    rows that share that key one stays, whichever. A null key comes after all others,
    and a group of null keys only has a null keep_id and keeps one row. ``key`` is a
    whole number or text. Columns named like new ones are replaced, others stay; an
    empty table gives no rows. ``hash_bits`` below 64 makes different texts share a
    hash, which changes nothing but speed.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep}")
    spark, new = docs.sparkSession, ["keep_id", "group_size", "kept", "text_sha256"]
    largest, kinds, own = keep == "largest", dict(docs.dtypes), [c for c in docs.columns if c not in new]
    same = normal is None
    body = F.coalesce(F.col(text).cast("string") if same else normal(F.coalesce(F.col(text), F.lit(""))), F.lit(""))
    # Rows travel under names of their own: theirs may clash with what is added.
    names = {c: f"c{i}" for i, c in enumerate(own)}
    carried = [F.col(c).alias(names[c]) if c != text or not same else F.col(c).isNull().alias(names[c]) for c in own]
    kinds = {names[c]: "boolean" if c == text and same else kinds[c] for c in own}
    digest = F.xxhash64(body) if hash_bits >= 64 else F.xxhash64(body).bitwiseAND(F.lit((1 << hash_bits) - 1))
    rows = docs.select(*carried, body.alias("__body"), digest.alias("__hash"))
    texts = materialize(local_texts(rows, key=names[key], largest=largest, kinds=kinds, most_bytes=local_bytes, most_rows=local_rows).withColumn("sha", F.sha2("body", 256)), "local-texts")

    pending, done, moved = texts, [], []
    for _ in range(rounds):
        whole = pending.agg(F.sum("length")).first()[0] or 0
        partitions = max(shuffle_partitions(spark), -(-whole // PARTITION_BYTES))
        out = materialize(settle(pending, kind=kinds[names[key]], largest=largest, budget=budget, partitions=partitions), "settled-texts")
        done.append(out.where("size is not null").select("local", "keep", "winner", "size"))
        pending = out.where("body is not null").select("local", "length", "hash", "body", F.col("keep").alias("best"), "rows")
        if pending.isEmpty():
            break
        moved.append(out.where("size is null and body is null").select("local", "winner"))
    else:
        raise RuntimeError(f"texts are not settled after {rounds} rounds")
    settled = done[-1]
    for ready, of in zip(reversed(done[:-1]), reversed(moved), strict=True):  # those that point to a string carried on get what it got
        settled = ready.unionByName(settled).unionByName(of.withColumnRenamed("winner", "to").join(settled.withColumnRenamed("local", "to"), "to").drop("to"))

    members = texts.select("local", "sha", "members", *([] if text not in own or not same else ["body"])).join(settled, "local")
    each = members.select("*", F.posexplode("members").alias("place", "row"))
    back = [(F.when(~F.col(f"row.{names[c]}"), F.col("body").cast("string")) if c == text and same else F.col(f"row.{names[c]}")).alias(c) for c in own]
    return each.select(*back, F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), ((F.col("local") == F.col("winner")) & (F.col("place") == 0)).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that ``owners`` keeps, with their own columns."""
    return owners(docs, **how).where("kept").select([c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")])
