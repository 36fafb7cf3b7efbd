"""Large JSON envelopes, each read by many tasks.

An envelope is one JSON document, so a reader that must see its beginning is one task. Here Spark splits the
file by bytes, as it does with lines: fragments end at a closing brace instead of a line end, and a task joins those that
follow one another to chunks. Whether a chunk begins inside a text, and how deep, follows from sums over all chunks
before it (first by block of the file, then within a block); with that every chunk is cut into the items of the
envelope's arrays by itself. Only an item that goes over the end of a chunk is put together from several.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewell.session import ensure_checkpoint_dir
from tradewell.sources.feeds import FILE, POSITION, Feed, folder_exists, is_record, parsed, rename

_CHUNK = ["bloque", "trozo"]
_PLACE = [*_CHUNK, "sub"]
_FILE = ["empresa_erp", FILE]
#: Bytes of text after which a chunk ends with the next fragment.
CHUNK_BYTES = 1 << 20
#: Bytes of text whose chunks a task cuts.
TASK_BYTES = 64 << 20
_QUOTE, _BACKSLASH, _OPEN, _CLOSE = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[list(b'"\\{[}]')] = [_QUOTE, _BACKSLASH, _OPEN, _OPEN, _CLOSE, _CLOSE]
_BRACE, _BOM = ord("}"), b"\xef\xbb\xbf"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as compressed files of the shared folder; a checkpoint would hold them as they are in memory.

    Spark knows the size of files, so that it broadcasts what is small instead of shuffling the text. These are not
    split when read, whatever the size the envelopes are split at: each is what one task wrote.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tradewell/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "gzip").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Exclusive running sums in the order (bloque, ``order``) of each group.

    A row's sum is that of the earlier blocks and that of the earlier rows of its block, so no task orders a
    whole file. ``df`` is read twice and should be stored.
    """
    rows = df.withColumns({f"__{n}": c.cast("long") for n, c in sums.items()})
    before = Window.partitionBy(*by).orderBy("bloque").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*by, "bloque").agg(*[F.sum(f"__{n}").alias(n) for n in sums]).select(
        *[F.col(c).alias(f"__b_{c}") for c in [*by, "bloque"]],
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__base_{n}") for n in sums])
    within = Window.partitionBy(*by, "bloque").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumns({n: F.coalesce(F.sum(f"__{n}").over(within), F.lit(0)) for n in sums})
    same = [F.col(c) == F.col(f"__b_{c}") for c in [*by, "bloque"]]
    joined = summed.join(blocks, same)
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"__base_{n}")).alias(n) for n in sums])


def _brackets(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of brackets, +1 or -1 for each, whether an odd number of quotation marks is before it; and that number for all."""
    kind = _KIND[text]
    at = np.flatnonzero(kind)
    kind = kind[at]
    if (slashes := at[kind == _BACKSLASH]).size:
        # A backslash takes the next character with it, so a row of an odd number takes the one behind it; no brace, where fragments end.
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        size = np.diff(first, append=len(slashes))
        taken = (slashes[first] + size)[size % 2 == 1]
        plain = (kind != _BACKSLASH) & ~(np.isin(at, taken) & (text[at] != _BRACE))
        at, kind = at[plain], kind[plain]
    marks = kind == _QUOTE
    odd = np.cumsum(marks) % 2 == 1
    return at[~marks], np.where(kind[~marks] == _OPEN, 1, -1), odd[~marks], int(marks.sum()) % 2


_CHUNK_TYPES = pa.schema([
    ("empresa_erp", pa.string()), (FILE, pa.string()), ("bloque", pa.int64()), ("trozo", pa.int64()), ("texto", pa.binary()),
    ("bytes", pa.int64()), ("blanco", pa.bool_()), ("impar", pa.int64()), ("si_fuera", pa.int64()), ("si_dentro", pa.int64())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the fragments of a block to chunks, each with what it does to the depth if it begins inside of a text or not."""
    number = 0
    for batch in batches:
        if not len(batch):
            continue
        company, name, block, texts = (batch.column(c) for c in ("empresa_erp", FILE, "bloque", "texto"))
        texts = texts.cast(pa.binary())
        start = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
        fresh = np.zeros(len(batch), bool)
        for column in (company, name, block):
            fresh[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        for low, high in zip(edges := [0, *np.flatnonzero(fresh).tolist()], [*edges[1:], len(batch)], strict=True):
            while low < high:
                end = min(high, int(np.searchsorted(start, start[low] + CHUNK_BYTES)) + 1)
                own = texts[low:end]
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), b"}")[0].as_py()
                if not block[low].as_py() and text.startswith(_BOM):
                    text = text[len(_BOM) :]
                _, step, odd, all_odd = _brackets(np.frombuffer(text + b"}", np.uint8))
                row = [company[low], name[low], block[low], number, pa.compress(text, "zstd", asbytes=True), len(text),
                       not own[-1].as_py().strip(b" "), all_odd, int(step[~odd].sum()), int(step[odd].sum())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x.as_py() if isinstance(x, pa.Scalar) else x], t) for x, t in zip(row, _CHUNK_TYPES.types, strict=True)],
                    schema=_CHUNK_TYPES)
                number, low = number + 1, end


def fragments(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """The files' text in chunks that end at a closing brace, which is left out: company, file, block of the file, number.

    ``texto`` is compressed and has so many ``bytes``; ``blanco`` says that nothing but blanks is behind the last brace within it.
    """
    kinds = (f"empresa_erp string, {FILE} string, bloque long, trozo long, texto binary, bytes long, blanco boolean, "
             "impar long, si_fuera long, si_dentro long")
    parts = [
        spark.read.option("lineSep", "}").text(folder).select(
            F.lit(company).alias("empresa_erp"), F.input_file_name().alias(FILE), F.col("_metadata.file_block_start").alias("bloque"),
            F.col("value").alias("texto"))
        for company, folder in folders.items() if folder_exists(spark, folder)
    ]
    if not parts:
        return spark.createDataFrame([], kinds)
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stored(stacked.mapInArrow(_chunks, kinds), "trozos")  # the order of a chunk is where it was read


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts chunks where the depth passes from 1 to 2 or back, and what is deeper behind each brace that returns to 2."""
    columns = ["texto", "bytes", "final", "dentro", "hondo"]
    for batch in batches:
        keys = [batch.column(c) for c in [*_FILE, *_CHUNK]]
        for i, (packed, size, end, quoted, depth) in enumerate(zip(*(batch.column(c).to_pylist() for c in columns), strict=True)):
            data = pa.py_buffer(pa.decompress(packed, size, "zstd", asbytes=True) + end.encode())
            text = np.frombuffer(data, np.uint8)
            at, step, odd, _ = _brackets(text)
            at, step = at[odd == quoted], step[odd == quoted]
            deep = depth + np.cumsum(step)
            edge = ((step > 0) & (deep == 2)) | ((step < 0) & (deep == 1))
            edges = (at + (step > 0))[edge]
            closed = at[(step < 0) & (deep == 2) & (text[at] == _BRACE)] + 1
            rows: list[tuple[bool, bool, pa.Array, pa.Array]] = []

            def strings(bounds: np.ndarray, data: pa.Buffer = data) -> pa.Array:
                return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), data)

            def add(outside: bool, closes: bool, bounds: list, rows: list = rows) -> None:
                """One text, or the texts of several whole segments."""
                whole = len(bounds) > 2 or (closes and not outside and begun)
                one, many = (pa.nulls(1, pa.string()), strings(np.array(bounds))) if whole else (strings(np.array(bounds)), None)
                rows.append((outside, closes, one, pa.ListArray.from_arrays(pa.array([0, len(many)], pa.int32()), many)
                             if whole else pa.nulls(1, pa.list_(pa.string()))))

            outside, begun = depth <= 1, depth == 2 and not quoted  # the brace before a chunk has closed what it closed
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(text)], strict=True):
                last = high == len(text)
                if low == high:
                    pass
                elif outside:
                    add(True, True, [low, high])
                else:
                    cuts = closed[np.searchsorted(closed, low, "right") : np.searchsorted(closed, high, "right")].tolist()
                    if not begun and (cuts or not last):  # the end of a segment that began before this chunk
                        add(False, True, [low, cut := cuts.pop(0) if cuts else high])
                        low, begun = cut, True
                    rest = cuts[-1] if cuts else low
                    if not last and rest < high:
                        cuts, rest = [*cuts, high], high
                    if cuts:
                        add(False, True, [low, *cuts])
                    if rest < high:
                        begun = False
                        add(False, False, [rest, high])
                outside, begun = not outside, True
            take = pa.array([i] * len(rows), pa.int32())
            yield pa.RecordBatch.from_arrays([
                *(k.take(take) for k in keys), pa.array(range(len(rows)), pa.int32()), pa.array([r[0] for r in rows], pa.bool_()),
                pa.array([r[1] for r in rows], pa.bool_()), *(pa.concat_arrays([r[k] for r in rows]) if rows else pa.array([], t)
                for k, t in ((2, pa.string()), (3, pa.list_(pa.string()))))], [*_FILE, *_PLACE, "fuera", "cierra", "texto", "segmentos"])


def _items(segment: Column) -> Column:
    listed = F.from_json(F.concat(F.lit("["), F.regexp_replace(segment, r"^\s*,", ""), F.lit("]")), "array<string>")
    return F.coalesce(listed, F.array().cast("array<string>"))


def pieces(read: DataFrame) -> DataFrame:
    """The chunks of ``fragments``, cut at the depth of items: (empresa_erp, archivo, bloque, trozo, sub, fuera, cierra, texto, items).

    ``fuera`` is ``texto`` of the envelope itself, with the brackets that open and close what it holds. The rest
    belongs to items: those that are whole are ``items`` of one row, in order; the others are ``texto``, and ``cierra`` says
    that an item, or a list's remainder, ends with it.
    """
    numbers = stored(read.drop("texto"), "numeros")
    total = numbers.agg(F.sum("bytes")).first()[0] or 0
    texts = running(numbers, _FILE, ["trozo"], {"dentro": F.col("impar")})
    inside = F.col("dentro") % 2 == 1
    texts = stored(texts.select(*_FILE, *_CHUNK, "blanco", inside.alias("dentro"), F.when(inside, F.col("si_dentro")).otherwise(
        F.col("si_fuera")).alias("cambio")), "textos")
    last = texts.groupBy(*_FILE).agg(F.max(F.struct(*_CHUNK)).alias("__last")).select(
        F.col("empresa_erp").alias("__e"), F.col(FILE).alias("__f"), "__last")
    deep = running(texts, _FILE, ["trozo"], {"hondo": F.col("cambio")}).join(
        last, (F.col("empresa_erp") == F.col("__e")) & (F.col(FILE) == F.col("__f")))
    final = F.when(F.col("blanco") & (F.struct(*_CHUNK) == F.col("__last")), "").otherwise("}")
    states = stored(deep.select(*_FILE, *_CHUNK, final.alias("final"), "dentro", "hondo"), "hondura")
    kinds = (f"empresa_erp string, {FILE} string, bloque long, trozo long, sub int, fuera boolean, cierra boolean, texto string, "
             "segmentos array<string>")
    # Compressed files of many chunks would be few tasks, of uneven work.
    chunks = read.select(*_FILE, *_CHUNK, "texto", "bytes").repartition(1 + total // TASK_BYTES, *_FILE, *_CHUNK)
    cut = chunks.join(states, [*_FILE, *_CHUNK]).mapInArrow(_cut, kinds)
    return cut.select(*_FILE, *_PLACE, "fuera", "cierra", "texto", F.flatten(F.transform("segmentos", _items)).alias("items"))


def split_envelopes(spark: SparkSession, folders: dict[str, str], feed: Feed) -> DataFrame:
    """The records that ``feeds.read_envelopes`` reads, whatever the size of a file; ``posicion`` is the same too.

    Files whose brackets do not close, or that state another status than OK, have no records. The text is kept once,
    compressed, and shuffled so; it is cut twice, to count the items before each row and to read them. Text outside of the lists must fit a task, and so must each item.
    """
    cut = pieces(fragments(spark, folders))
    counted = stored(cut.select(*_FILE, *_PLACE, "fuera", "cierra", "texto", F.size("items").cast("long").alias("n")), "piezas")
    placed = stored(running(counted, _FILE, ["trozo", "sub"], {
        "tramo": F.col("fuera"), "segmento": F.col("fuera") | F.col("cierra")}), "tramos")
    around = placed.filter("fuera").groupBy(*_FILE).agg(F.array_sort(F.collect_list(
        F.struct("tramo", *_PLACE, "texto"))).alias("partes"))
    # With the lists' contents left out the envelope is a small document; one that does not close is null.
    skeleton = parsed(around.withColumn("texto", F.array_join("partes.texto", "")), "texto", feed, [*_FILE, "partes"])
    stated = [F.col(c).isNotNull() for c in feed.arrays]
    usable = (F.col("status") == "OK") if feed.checked else F.lit(True)
    for c in stated[1:]:
        stated[0] = stated[0] | c
    names = skeleton.filter(usable & stated[0]).select(*_FILE, F.explode("partes").alias("p")).select(
        *_FILE, (F.col("p.tramo") + 1).alias("tramo"), F.regexp_extract("p.texto", r'"([^"\\]*)"\s*:\s*\[$', 1).alias("lista"))
    names = stored(names.filter(F.col("lista").isin(*feed.arrays)), "listas")

    listed = stored(placed.filter("not fuera").join(names, [*_FILE, "tramo"]), "listados")
    spread = listed.filter("texto IS NOT NULL").groupBy(*_FILE, "lista", "tramo", "segmento").agg(
        F.array_sort(F.collect_list(F.struct(*_PLACE, "texto"))).alias("p")).select(
        *_FILE, "lista", *[F.col("p")[0][c].alias(c) for c in _PLACE], _items(F.array_join("p.texto", "")).alias("items"))
    spread = stored(spread, "repartidos")
    segments = listed.filter("texto IS NULL").select(*_FILE, "lista", *_PLACE, "n").unionByName(
        spread.select(*_FILE, "lista", *_PLACE, F.size("items").cast("long").alias("n")))
    segments = stored(segments.filter("n > 0"), "segmentos")
    rank = {name: i for i, name in enumerate(feed.arrays)}
    order = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    # Of several lists the first one that is not empty counts.
    first = segments.groupBy(*_FILE).agg(F.min(order[F.col("lista")]).alias("elegida"))
    chosen = running(segments, [*_FILE, "lista"], ["trozo", "sub"], {"antes": F.col("n")}).join(first, _FILE).filter(
        order[F.col("lista")] == F.col("elegida"))
    chosen = stored(chosen.select(*_FILE, *_PLACE, "antes"), "sitios")
    whole = cut.filter("texto IS NULL").select(*_FILE, *_PLACE, "items").unionByName(spread.select(*_FILE, *_PLACE, "items"))
    opened = whole.join(chosen, [*_FILE, *_PLACE]).select(
        *_FILE, "antes", F.posexplode("items").alias("__n", "__item")).filter(is_record(F.col("__item"))).select(
        *_FILE, (F.col("antes") + F.col("__n")).cast("int").alias(POSITION), F.from_json("__item", feed.record).alias("__r"))
    return rename(opened.select("empresa_erp", FILE, "__r.*", POSITION), feed)
