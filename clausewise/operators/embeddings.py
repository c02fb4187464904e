"""Embedding operators (E1-E8): vector arithmetic over tables.

Encoders are inputs: either a stored vector table joined in, or a user-supplied
vectorised function run through ``mapInPandas`` (model loaded once per task,
Arrow batches).  Everything after that is relational: equi-joins on
``(sentence, word)`` / ``vec_id``, ordered folds inside small groups (the
pieces of one word), and element-wise means per clause or sentence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from clausewise.functions.vectors import as_double, bounded_group_mean, mean_vector, vadd, vmid, zeros
from clausewise.session import ship_package, written


#: Start and end of a sentence as encoders mark them (fixed values).
SENTENCE_MARKS = ("[CLS]", "[SEP]")


def attach_hidden_states(df: DataFrame, make_encoder: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]] | None = None,
                         schema: str | None = None, stored: DataFrame | None = None,
                         key: str | list[str] = "sentence_id", how: str = "inner") -> DataFrame:
    """Add encoder outputs to rows.

    With ``stored``, a stored table is equi-joined on ``key`` (``how="left"``
    keeps the rows that it has nothing for, with nulls).  With
    ``make_encoder``, that is called once per task (it loads the model) and
    returns a function from a pandas batch to a pandas batch with the ``schema``
    columns, which runs per Arrow batch inside the executors.
    """
    if make_encoder is not None:
        from clausewise.session import ship_package
        ship_package(df.sparkSession)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = make_encoder()
            for b in batches:
                yield encode(b)
        return df.mapInPandas(run, schema=schema)
    if stored is None:
        raise ValueError("give an encoder function or a stored table")
    return df.join(stored, key, how)


def sum_last_layers(df: DataFrame, layers_col: str = "layers", k: int = 2, out_col: str = "vector") -> DataFrame:
    """Element-wise sum of the last ``k`` layers of every piece."""
    last = F.slice(F.col(layers_col), -k, k)
    first = as_double(F.element_at(last, 1))
    summed = F.aggregate(F.slice(last, 2, k - 1), first, lambda acc, v: vadd(acc, as_double(v))) if k > 1 else first
    return df.withColumn(out_col, summed)


def word_index(pieces: DataFrame, group: list[str], order: list[str], text_col: str = "piece",
               prefix: str = "##") -> DataFrame:
    """1-based ``word_idx`` of every piece: running count of word starts (pieces
    not beginning with ``prefix``).  Run it before vectors are attached, so the
    window sorts narrow rows."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    starts = (~F.col(text_col).startswith(prefix)).cast("int")
    return pieces.withColumn("word_idx", F.sum(starts).over(w).cast("long"))


def halve_pairs(vectors: Column) -> Column:
    """Average neighbours (1st with 2nd, 3rd with 4th, ...) until one vector is left."""
    levels = F.sequence(F.lit(0), F.size(vectors))

    def halve(vs: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / 2).cast("int"))
        return F.when(F.size(vs) < 2, vs).otherwise(F.transform(pairs, lambda i: F.when(
            2 * i + 1 < F.size(vs), vmid(F.get(vs, 2 * i), F.get(vs, 2 * i + 1))).otherwise(F.get(vs, 2 * i))))

    # the number of levels is logarithmic; once a single vector is left a level changes nothing
    few = F.slice(levels, 1, F.ceil(F.log2(F.size(vectors).cast("double") + 1)).cast("int"))
    return F.element_at(F.aggregate(few, vectors, halve), 1)


def fold_pieces(tagged: DataFrame, group: list[str], order: list[str], text_col: str = "piece",
                vec_col: str = "vector", prefix: str = "##") -> DataFrame:
    """Fold the pieces of each ``word_idx`` (see :func:`merge_word_pieces`).

    One plain grouping with one list per word; rows already hash-partitioned by
    ``group`` (by :func:`word_index`) satisfy its distribution, so there is no
    further shuffle."""
    text = F.regexp_replace(F.col(text_col), "^" + prefix, "").alias("t")
    item = F.struct(*[F.col(c) for c in order], text, as_double(vec_col).alias("v"))
    words = tagged.groupBy(*group, "word_idx").agg(F.array_sort(F.collect_list(item)).alias("_seq"))
    return words.select(*group, "word_idx", F.array_join(F.transform("_seq", lambda s: s["t"]), "").alias("word"),
                        halve_pairs(F.transform("_seq", lambda s: s["v"])).alias(vec_col))


def piece_lists(tagged: DataFrame, group: list[str], order: list[str], text_col: str | None = "piece", id_col: str = "h0",
                out_col: str = "pieces", prefix: str = "##", near: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """E3 by reference: for every group the pieces of its words in order, ``group + [out_col]``.

    ``out_col`` holds equally long lists: ``ids`` (of stored vectors), ``words`` (their
    ``word_idx``) and, with ``text_col``, ``texts``.  :func:`fold_stored` and
    :func:`attach_folded` give the folded words and their means.  ``near``: columns that
    the group determines and by which rows already lie together; ``keep``: those that stay."""
    text = [F.regexp_replace(F.col(text_col), "^" + prefix, "").alias("t")] if text_col else []
    item = F.struct(F.col("word_idx").cast("int").alias("w"), *[F.col(c) for c in order], *text, F.col(id_col).alias("id"))
    rows = tagged.groupBy(*near, *group).agg(F.array_sort(F.collect_list(item)).alias("_seq"))
    lists = {"ids": "id", "words": "w", **({"texts": "t"} if text_col else {})}
    return rows.select(*keep, *group, F.struct(*[F.col(f"_seq.{c}").alias(out) for out, c in lists.items()]).alias(out_col))


def merge_word_pieces(pieces: DataFrame, group: list[str], order: list[str], text_col: str = "piece",
                      vec_col: str = "vector", prefix: str = "##") -> DataFrame:
    """Fold continuation pieces (``##...``) into the word before them.

    Passes over the pieces average each continuation with the piece before it
    and go on behind it, until no continuation is left: ``a, ##b, ##c`` give
    ``((a + b) / 2 + c) / 2`` and ``a, ##b, ##c, ##d`` give
    ``((a + b) / 2 + (c + d) / 2) / 2`` (not the plain mean).
    Returns ``group + [word_idx, word, vec_col]``; ``word_idx`` is 1-based.
    """
    return fold_pieces(word_index(pieces, group, order, text_col, prefix), group, order, text_col, vec_col, prefix)


def sentence_embedding(words: DataFrame, group: list[str], vec_col: str = "vector",
                       out_col: str = "embedding", stored: DataFrame | None = None, id_col: str = "h0") -> DataFrame:
    """Mean over the (merged) word vectors of a sentence (a bounded group), with the
    marks of its start and end where the encoder gives them.  With ``stored`` the
    sentences are lists of pieces (:func:`piece_lists` in ``vec_col``) of its vectors."""
    if stored is not None:
        return attach_folded(words.select(*group, vec_col), stored, {out_col: vec_col}, {"n_words": vec_col}, True, id_col)
    return bounded_group_mean(words, list(group), vec_col, out_col, "n_words")


def word_vectors(words: DataFrame, sentence_key: str = "sentence_id", word_col: str = "word",
                 pos_col: str | Column = "pos", value_col: str = "vec_id", marks: Sequence[str] = (),
                 near: Sequence[str] = ()) -> DataFrame:
    """E5: word -> vector (or vector id) within a sentence; a repeated word keeps the last.

    ``near``: columns that the sentence determines and by which rows already lie together;
    they stay in the map, which then takes no exchange.

    ``marks``: signs of a sentence's start and end, which are no words of the map
    (``SENTENCE_MARKS`` of the usual encoders); E4 is worked out before, with them."""
    pos = F.col(pos_col) if isinstance(pos_col, str) else pos_col
    words = words.filter(~F.col(word_col).isin(*marks)) if marks else words
    return words.groupBy(*near, sentence_key, word_col).agg(F.max_by(F.col(value_col), pos).alias(value_col))


def clause_embedding(clause_words: DataFrame, wvec: DataFrame, vectors: DataFrame,
                     sentence_key: str = "sentence_id", clause_key: str = "clause_id", word_col: str = "word",
                     id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Mean over a clause's words found in its sentence's word map.

    Repeated words count each time; a clause without any hit has no row.
    ``wvec`` maps ``(sentence, word) -> id_col``; ``vectors`` maps ``id_col -> vec_col``.
    """
    hits = clause_words.join(wvec, [sentence_key, word_col], "inner").join(vectors, id_col, "inner")
    return bounded_group_mean(hits, [clause_key], vec_col, vec_col, "n_vec")


#: Ids that the rows of a block hold together, as expected, and ids whose vectors are added up at a time.
BLOCK_IDS, ADDED = 1 << 19, 1 << 14
#: Packs of rows that a block has at least, if it is as large as expected.
PACKS = 8


class StoredVectors:
    """The stored vectors that a block of rows refers to: ids (also repeated) and a matrix."""

    def __init__(self, ids: pa.ChunkedArray, vectors: pa.ChunkedArray):
        held = _flat(ids).dictionary_encode()
        self.known = held.dictionary
        codes = np.asarray(held.indices, dtype=np.int64)
        self.order = np.argsort(codes, kind="stable")
        self.starts = np.append(0, np.cumsum(np.bincount(codes, minlength=len(self.known))))
        vectors = _flat(vectors)
        self.valid = np.asarray(vectors.is_valid())
        sizes = np.asarray(pc.list_value_length(vectors).fill_null(0), dtype=np.int64)
        self.width, flat = int(sizes.max(initial=0)), vectors.flatten()
        self.holes = None
        if (sizes == self.width).all() and not flat.null_count:
            self.matrix = np.asarray(flat).reshape(len(sizes), self.width)
        else:  # vectors of other widths, or with nulls inside
            at = np.arange(self.width) < sizes[:, None]
            self.matrix, self.holes = np.zeros((len(sizes), self.width)), ~at
            self.matrix[at] = np.asarray(flat.fill_null(0), dtype=float)
            self.holes[at] = np.asarray(flat.is_null())
        self.sizes = sizes

    def rows_of(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every vector that an id of the lists has: the list, the row of the matrix, and the id's place in all lists."""
        of = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists).fill_null(0)))
        code = np.asarray(pc.index_in(lists.flatten(), value_set=self.known).fill_null(-1), dtype=np.int64)
        item = np.flatnonzero(code >= 0)
        of, code = of[item], code[item]
        copies = self.starts[code + 1] - self.starts[code]
        at = np.repeat(self.starts[code], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        return np.repeat(of, copies), self.order[at], np.repeat(item, copies)

    def means(self, lists: pa.ListArray) -> tuple[pa.ListArray, pa.Array]:
        """Element-wise mean of the vectors of each list (null: none), and their number (null: no id is known)."""
        of, at, _ = self.rows_of(lists)
        found = np.bincount(of, minlength=len(lists)) > 0
        of, at = of[self.valid[at]], at[self.valid[at]]
        n = np.bincount(of, minlength=len(lists))
        total = _added(self.matrix, of, at, len(lists))
        with np.errstate(invalid="ignore", divide="ignore"):
            total /= n[:, None]
        if self.holes is None:
            width, holes = np.where(n > 0, self.width, 0), None
        else:
            width = np.zeros(len(lists), dtype=np.int64)
            np.maximum.at(width, of, self.sizes[at])
            holes = _added(self.holes, of, at, len(lists)) > 0
        return _lists(total, width, holes, n > 0), pa.array(n, mask=~found)

    def sort_copies(self) -> None:
        """Vectors of one id in the order of their values (nulls first), so that the order they came in decides nothing."""
        for k in np.flatnonzero(np.diff(self.starts) > 1):
            rows = self.order[self.starts[k]:self.starts[k + 1]]
            self.order[self.starts[k]:self.starts[k + 1]] = sorted(rows, key=lambda r: (self.valid[r], tuple(self.matrix[r])))

    def folded(self, pieces: pa.StructArray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array | None, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The words of lists of pieces, some lists at a time: list, ``word_idx``, text, vector, nulls inside it, width, and whether it has a vector.

        Neighbours are averaged until one vector is left (:func:`halve_pairs`): a piece's
        weight is halved at every level at which it has a neighbour."""
        sizes = np.asarray(pc.list_value_length(pieces.field("ids")).fill_null(0), dtype=np.int64)
        part = np.cumsum(sizes) // ADDED
        for k in np.unique(part):
            first, n = int(np.searchsorted(part, k)), int((part == k).sum())
            some = {f.name: pieces.field(f.name).slice(first, n) for f in pieces.type}
            of, at, item = self.rows_of(some["ids"])
            if not len(of):
                continue
            idx = np.asarray(some["words"].flatten(), dtype=np.int64)[item]
            new = np.append(True, (of[1:] != of[:-1]) | (idx[1:] != idx[:-1]))
            starts, word = np.flatnonzero(new), np.cumsum(new) - 1
            count = np.diff(np.append(starts, len(of)))
            i, m, weight = np.arange(len(of)) - starts[word], count[word], np.ones(len(of))
            while (m > 1).any():
                weight[(m > 1) & ~((i == m - 1) & (m % 2 == 1))] *= 0.5
                i, m = i // 2, (m + 1) // 2
            vector = np.add.reduceat(self.matrix[at] * weight[:, None], starts, axis=0)
            width = np.maximum.reduceat(self.sizes[at], starts)
            holes = np.zeros(vector.shape, dtype=bool) if self.holes is None else np.logical_or.reduceat(self.holes[at], starts, axis=0)
            text = None
            if "texts" in some:
                each = some["texts"].flatten().take(pa.array(item)).fill_null("")
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(of)), pa.int32()), each), "")
            yield first + of[starts], idx[starts], text, vector, holes, width, np.logical_and.reduceat(self.valid[at], starts)

    def folded_means(self, pieces: pa.StructArray) -> tuple[pa.ListArray, pa.Array]:
        """Element-wise mean of the folded words of each list of pieces (null: none), and their number (null: no id is known)."""
        rows = len(pieces)
        total, bad = np.zeros((rows, self.width)), np.zeros((rows, self.width), dtype=bool)
        n, width, found = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=bool)
        for of, _, _, vector, holes, wide, known in self.folded(pieces):
            found[of] = True
            of = of[known]
            np.add.at(n, of, 1)
            np.maximum.at(width, of, wide[known])
            if len(of):
                first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                total[of[first]] += np.add.reduceat(vector[known], first, axis=0)
                bad[of[first]] |= np.logical_or.reduceat(holes[known], first, axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            total /= n[:, None]
        return _lists(total, width, None if self.holes is None else bad, n > 0), pa.array(n, mask=~found)


def _lists(matrix: np.ndarray, width: np.ndarray, holes: np.ndarray | None, there: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists of their own width (null where not ``there``), with nulls in ``holes``."""
    here = np.arange(matrix.shape[1]) < width[:, None]
    values = pa.array(matrix[here], mask=None if holes is None else holes[here])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)), pa.int32()), values, mask=pa.array(~there))


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _pieces(column: pa.ChunkedArray) -> pa.StructArray:
    """Lists of pieces without null rows (none: empty lists)."""
    flat = _flat(column)
    return pa.StructArray.from_arrays([pc.if_else(flat.is_valid(), flat.field(f.name), pa.scalar([], f.type)) if flat.null_count else flat.field(f.name)
                                       for f in flat.type], [f.name for f in flat.type])


def _added(matrix: np.ndarray, of: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows ``at`` of the matrix by ``of``, which ascends."""
    total = np.zeros((n, matrix.shape[1]))
    for k in range(0, len(of), ADDED):
        some = of[k:k + ADDED]
        first = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
        total[some[first]] += np.add.reduceat(matrix[at[k:k + ADDED]].astype(float), first, axis=0)
    return total


def over_stored(rows: DataFrame, vectors: DataFrame, ids: Sequence[str | Column], work: Callable[[pa.Table, StoredVectors], pa.Table],
                schema: str, id_col: str = "vec_id", vec_col: str = "embedding", also: Sequence[Column] = ()) -> DataFrame:
    """``work`` on blocks of rows, each with the stored vectors that its columns ``ids`` (lists of ids) name.

    Rows stay narrow and packed: some at a time become one compressed value, which is written
    once and dealt over blocks, and a block is sent each of its vectors once, however many of
    its rows name it.  The number of blocks
    grows with the number of ids (and of what ``also`` counts in a row), so that a block
    stays as large, whatever the input."""
    ship_package(rows.sparkSession)
    own, extra = "_block", "_ids"
    while extra in rows.columns or f"{extra}n" in rows.columns:
        extra += "_"
    names = F.flatten(F.array(*[F.coalesce(F.col(c) if isinstance(c, str) else c, F.array()) for c in ids]))
    load = sum((F.coalesce(n, F.lit(0)).cast("long") for n in also), F.size(names).cast("long"))
    wide = rows.select("*", names.alias(extra), load.alias(f"{extra}n"))
    kind, most = wide.schema[extra].dataType.simpleString(), max(BLOCK_IDS // PACKS, 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            loads = np.cumsum(np.asarray(batch.column(f"{extra}n"))) // most
            if not len(loads):
                continue
            ends = np.append(np.flatnonzero(np.diff(loads)) + 1, len(loads))
            for first, end in zip(np.append(0, ends[:-1]), ends, strict=True):
                some = pa.Table.from_batches([batch.slice(first, end - first)])
                held = some.drop_columns([extra, f"{extra}n"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                    to.write_table(held)
                known = _flat(some.column(extra)).flatten().unique()
                yield pa.RecordBatch.from_pydict({"rows": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                                                  "ids": pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known),
                                                  "n": pa.array([pc.sum(some.column(f"{extra}n")).as_py()], pa.int64())})

    none = to_arrow_schema(rows.schema).empty_table()
    kept = written(wide.mapInArrow(pack, f"rows binary, ids {kind}, n bigint").withColumn("at", F.monotonically_increasing_id()))
    total = kept.agg(F.sum("n")).first()[0] or 0
    blocks = max(2 * kept.sparkSession.sparkContext.defaultParallelism, -(-total // BLOCK_IDS))
    block = F.pmod(F.xxhash64("at"), F.lit(blocks).cast("long")).cast("int").alias(own)
    left = kept.select(block, "rows")
    right = kept.select(block, F.explode("ids").alias("_id")).distinct().join(vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec")), "_id").select(own, "_id", "_vec")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        packs = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in left.column("rows")]
        table = pa.concat_tables(packs) if packs else none
        return work(table, StoredVectors(right.column("_id"), right.column("_vec")))

    return left.groupBy(own).cogroup(right.groupBy(own)).applyInArrow(run, schema)


def attach_means(rows: DataFrame, vectors: DataFrame, means: Mapping[str, str], counts: Mapping[str, str] | None = None,
                 needed: bool = True, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``rows`` with, for each ``out: ids`` of ``means``, the mean of the stored vectors that the list ``ids`` names.

    Repeated ids count each time, unknown ones not at all; ``counts`` (``out: ids``) adds how
    many vectors they were.  ``needed`` drops rows with a list of which no id is known, else
    the mean is null.  A list's column goes unless a mean has another name."""
    counts, lists = dict(counts or {}), list(dict.fromkeys(means.values()))
    stay = [c for c in rows.columns if c not in means and c not in counts]
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in stay], *[f"`{c}` array<double>" for c in means],
                        *[f"`{c}` bigint" for c in counts]])

    def work(left: pa.Table, stored: StoredVectors) -> pa.Table:
        got = {c: stored.means(_flat(left.column(c))) for c in lists}
        out = pa.table({**{c: left.column(c) for c in stay}, **{c: got[i][0] for c, i in means.items()}, **{c: got[i][1] for c, i in counts.items()}})
        if needed:
            out = out.filter(pa.array(np.logical_and.reduce([np.asarray(n.is_valid()) for _, n in got.values()])))
        return out

    return over_stored(rows, vectors, lists, work, schema, id_col, vec_col)


def attach_folded(rows: DataFrame, stored: DataFrame, means: Mapping[str, str], counts: Mapping[str, str] | None = None,
                  needed: bool = True, id_col: str = "h0", vec_col: str = "vector") -> DataFrame:
    """``rows`` with, for each ``out: pieces`` of ``means``, the mean of the words that the pieces fold to
    (as :func:`attach_means`; ``pieces`` as :func:`piece_lists` gives them)."""
    counts, lists = dict(counts or {}), list(dict.fromkeys(means.values()))
    stay = [c for c in rows.columns if c not in means and c not in counts and c not in lists]
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in stay], *[f"`{c}` array<double>" for c in means],
                        *[f"`{c}` bigint" for c in counts]])

    def work(left: pa.Table, vectors: StoredVectors) -> pa.Table:
        vectors.sort_copies()
        got = {c: vectors.folded_means(_pieces(left.column(c))) for c in lists}
        out = pa.table({**{c: left.column(c) for c in stay}, **{c: got[i][0] for c, i in means.items()}, **{c: got[i][1] for c, i in counts.items()}})
        if needed:
            out = out.filter(pa.array(np.logical_and.reduce([np.asarray(n.is_valid()) for _, n in got.values()])))
        return out

    return over_stored(rows, stored, [f"{c}.ids" for c in lists], work, schema, id_col, vec_col)


def fold_stored(rows: DataFrame, stored: DataFrame, pieces: str = "pieces", id_col: str = "h0", vec_col: str = "vector") -> DataFrame:
    """E3 of stored vectors: the words of lists of pieces (:func:`piece_lists`) with the sum and the square sum of their vectors.

    ``(other columns, word_idx, word, total, squares)``; both are null where a piece's vector is, and
    a word without any known piece has no row.  Vectors are folded in blocks
    (:func:`over_stored`) and do not leave them."""
    stay = [c for c in rows.columns if c != pieces]
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in stay], "word_idx bigint, word string, total double, squares double"])

    def work(left: pa.Table, vectors: StoredVectors) -> pa.Table:
        vectors.sort_copies()
        of, parts = [], []
        for row, idx, text, vector, holes, wide, known in vectors.folded(_pieces(left.column(pieces))):
            inside = np.arange(vectors.width) < wide[:, None]
            none = ~known | (holes & inside).any(axis=1)
            of.append(row)
            parts.append(pa.table({"word_idx": idx, "word": text, "total": pa.array(vector.sum(axis=1), mask=none),
                                   "squares": pa.array((vector * vector).sum(axis=1), mask=none)}))
        at = pa.array(np.concatenate(of) if of else [], pa.int64())
        words = pa.concat_tables(parts) if parts else pa.table({"word_idx": pa.array([], pa.int64()), "word": pa.array([], pa.string()),
                                                                "total": pa.array([], pa.float64()), "squares": pa.array([], pa.float64())})
        return pa.table({**{c: left.column(c).take(at) for c in stay}, **{c: words.column(c) for c in words.column_names}})

    return over_stored(rows, stored, [f"{pieces}.ids"], work, schema, id_col, vec_col)


def _cosines(vectors: pa.ListArray, left: np.ndarray, right: np.ndarray) -> pa.Array:
    """Cosine of pairs of rows: null where a vector is null, has a null inside or no length, or their widths differ."""
    sizes = np.asarray(pc.list_value_length(vectors).fill_null(0), dtype=np.int64)
    here = np.arange(sizes.max(initial=0)) < sizes[:, None]
    flat = vectors.flatten()
    x, holes = np.zeros(here.shape), np.zeros(here.shape, dtype=bool)
    x[here], holes[here] = np.asarray(flat.fill_null(0), dtype=float), np.asarray(flat.is_null())
    whole = np.asarray(vectors.is_valid()) & ~holes.any(axis=1)
    norms = np.sqrt((x * x).sum(axis=1))
    product = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", x[left[k:k + ADDED]], x[right[k:k + ADDED]]) for k in range(0, len(left), ADDED)]])
    both = norms[left] * norms[right]
    with np.errstate(invalid="ignore", divide="ignore"):
        return pa.array(product / both, mask=~(whole[left] & whole[right] & (sizes[left] == sizes[right]) & ((both > 0) | np.isnan(both))))


def compare_stored(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", folded: bool = False) -> Callable[..., DataFrame]:
    """A function ``(groups, left, right)`` that gives ``(left, right, cosine)`` of the pairs of groups of references.

    A row of ``groups`` has the lists ``ids`` and ``refs`` (lists of stored vectors' ids, with
    ``folded`` of pieces as :func:`piece_lists` gives them) and the pairs, ``left`` and ``right``
    (two of ``ids``).  Each reference is resolved once to its mean (as :func:`attach_means` or
    :func:`attach_folded`) for all of its pairs, and no vector leaves its block.  Pairs of an
    id that is not there, or that has no known vector, have no row."""

    def compare(groups: DataFrame, left: str, right: str) -> DataFrame:
        rows = groups.select("ids", "refs", left, right).withColumn("_n", F.monotonically_increasing_id())  # equal groups need not share a block
        kinds = [groups.schema[c].dataType.elementType.simpleString() for c in (left, right)]

        def work(table: pa.Table, stored: StoredVectors) -> pa.Table:
            ids, refs, a, b = (_flat(table.column(c)) for c in ("ids", "refs", left, right))
            if folded:
                stored.sort_copies()
            means, n = stored.folded_means(_pieces(pa.chunked_array([refs.flatten()]))) if folded else stored.means(refs.flatten())
            names = ids.flatten().dictionary_encode()
            width = len(names.dictionary) + 1

            def keys(lists: pa.ListArray, codes: pa.Array) -> np.ndarray:
                of = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
                return of * width + np.asarray(codes.fill_null(width - 1), dtype=np.int64)

            known = np.flatnonzero(np.asarray(n.is_valid()) & np.asarray(names.indices.is_valid()))
            at = keys(ids, names.indices)[known]
            order = np.argsort(at, kind="stable")
            known, at = known[order], at[order]
            first, few = [], []
            for lists in (a, b):
                k = keys(lists, pc.index_in(lists.flatten(), value_set=names.dictionary))
                first.append(np.searchsorted(at, k))
                few.append(np.searchsorted(at, k, side="right") - first[-1])
            times = few[0] * few[1]  # an id may be there more than once
            pair = np.repeat(np.arange(len(times)), times)
            i = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
            x, y = known[first[0][pair] + i // few[1][pair]], known[first[1][pair] + i % few[1][pair]]
            return pa.table({left: a.flatten().take(pa.array(pair)), right: b.flatten().take(pa.array(pair)), "cosine": _cosines(means, x, y)})

        known = F.filter(F.col("refs.ids" if folded else "refs"), lambda r: r.isNotNull())
        return over_stored(rows, vectors, [F.flatten(known)], work,
                           f"`{left}` {kinds[0]}, `{right}` {kinds[1]}, cosine double", id_col, vec_col, [F.size(left)])

    return compare


def clause_vector_ids(words: DataFrame, has_vector: Column, pos: Column, sentence_key: str = "sentence_id",
                      clause_key: str = "clause_id", word_col: str = "word", id_col: str = "vec_id",
                      out_col: str = "embedding", near: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """E5: for every clause the vector ids of its words, one for each occurrence (``out_col``, a list).

    ``words`` holds every word occurrence with its candidate vector id (used where
    ``has_vector``).  A window over ``(sentence, word)`` gives each occurrence the id of the
    word's last occurrence in the sentence (the sentence's word map), so the clause table is
    read once and no map is joined back.  Words are dealt by sentence: the one exchange
    serves the window and the clauses, which lie within a sentence.  ``near``: columns that
    the sentence determines and by which rows already lie together (then there is none).
    ``keep``: those of them, and the sentence, that stay in the result."""
    narrow = words.select(*near, sentence_key, clause_key, word_col, F.when(has_vector, F.col(id_col)).alias("_id"), F.when(has_vector, pos).alias("_pos"))
    w = Window.partitionBy(*near, sentence_key, word_col)
    last = F.max_by("_id", "_pos").over(w)
    hits = (narrow if near else narrow.repartition(sentence_key)).withColumn("_vid", last).filter(F.col("_vid").isNotNull())
    ids = hits.groupBy(*near, sentence_key, clause_key).agg(F.collect_list("_vid").alias(out_col))
    return ids.select(*keep, clause_key, out_col)


def clause_embedding_from_words(words: DataFrame, vectors: DataFrame, has_vector: Column, pos: Column,
                                sentence_key: str = "sentence_id", clause_key: str = "clause_id",
                                word_col: str = "word", id_col: str = "vec_id",
                                vec_col: str = "embedding") -> DataFrame:
    """E5 + E6 in one pass over the clause words: the ids of a clause's vectors, then their mean.

    A clause is expected to lie within one sentence.  Vectors meet clauses in blocks
    (:func:`over_stored`); what is joined first may take the ids and the mean last
    (:func:`clause_vector_ids`, :func:`attach_means`)."""
    ids = clause_vector_ids(words, has_vector, pos, sentence_key, clause_key, word_col, id_col, vec_col)
    return attach_means(ids, vectors, {vec_col: vec_col}, {"n_vec": vec_col}, True, id_col, vec_col)


def oov_counts(clause_words: DataFrame, wvec: DataFrame, sentence_key: str = "sentence_id",
               word_col: str = "word", near: Sequence[str] = ()) -> DataFrame:
    """Occurrences of words with no vector, per word.

    Occurrences are counted for each sentence and word, together with the entries of the
    map; nothing is joined.  ``near``: columns of both that the sentence determines and by
    which their rows already lie together (then only the counts of words are exchanged)."""
    keys = [*near, sentence_key, word_col]
    entries = wvec.filter(F.col(sentence_key).isNotNull() & F.col(word_col).isNotNull())  # null is equal to nothing
    both = clause_words.select(*keys, F.lit(1).cast("long").alias("_n"), F.lit(0).alias("_known")).unionByName(
        entries.select(*keys, F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_known")))
    miss = both.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.max("_known").alias("_known")).filter("_known = 0 AND _n > 0")
    return miss.groupBy(word_col).agg(F.sum("_n").alias("n"))


def with_default_vector(ids: DataFrame, emb: DataFrame, dim: int | Column, key: str = "clause_id",
                        vec_col: str = "embedding", resolve: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Every id gets a vector; a missing one is the zero vector.  ``resolve``: turns
    a column of references into vectors, once they are joined."""
    out = ids.join(emb.select(key, vec_col), key, "left")
    out = resolve(out, vec_col) if resolve else out
    return out.withColumn("has_vec", F.col(vec_col).isNotNull()).withColumn(
        vec_col, F.coalesce(as_double(vec_col), zeros(dim)))
