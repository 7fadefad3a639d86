"""Problem 1: cutting oversized chunks at natural boundaries, by dynamic programming over boundary positions."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papercairn.llm.sentences import Model
from papercairn.tables import blank, spread

#: An end mark with what closes after it, then white space; or an end mark of a script that needs no white space.
_SENTENCE_END = re.compile(r"[.!?؟।…][\"'”’»)\]]*(?:\[[\d,–-]+\])*\s+|[。！？｡][」』”）]*")
_SPACE = re.compile(r"\s+")
_ROWS = re.compile(r"(?:^|\n)([ \t]*\|[^\n]*\n[ \t]*\|?[ \t:|-]*-[ \t:|-]*\n)")

PARAGRAPH, SENTENCE, SPACE, HARD = range(4)
CUT_COST = (0.0, 0.25, 2.0, 6.0)
#: What each sentence of overlap left out costs.
LESS_OVERLAP = 0.5

PIECES = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("embed_text", T.StringType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("para_ids", T.ArrayType(T.StringType())),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("cut", T.StringType()),
        T.StructField("overlap", T.IntegerType()),
    ]
)


def full_text(df: DataFrame) -> F.Column:
    """embed_text, or the header and the text, or the text alone."""
    return F.coalesce(df["embed_text"], F.concat(df["context_header"], F.lit("\n\n"), df["text"]), df["text"])


def tokens(text: F.Column) -> F.Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("int")


def ends(text: str, table: bool, model: Model | None = None) -> dict[int, int]:
    """Where sentences or table rows end (with the white space behind them), each with the kind of its boundary. Sentences
    are those of the model, if there is one; else an end mark before white space ends one."""
    out: dict[int, int] = {len(text): PARAGRAPH}
    for m in re.finditer(r"\n\s*\n", text):
        out[m.end()] = PARAGRAPH
    if table:
        found = [m.end() for m in re.finditer(r"\n", text)]
    elif model is None:
        found = [m.end() for m in _SENTENCE_END.finditer(text)]
    else:
        found = [m.end() if (m := _SPACE.match(text, e)) else e for e in model.ends(text)]
    for e in found:
        out.setdefault(e, SENTENCE)
    return out


def places(text: str, whole: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(place, kind, where its sentence begins) of every place to cut at: ends of sentences, and within those that may not
    fit whole beside the overlap (a quarter of `most` or longer) ends of words, about sixteen for `most` characters;
    within words longer than that, anywhere."""
    out, start, step = [], 0, max(1, most // 16)
    for end in sorted(whole):
        at = start
        while end - start >= most // 4 and end - at > step:
            gaps = [m.end() for m in _SPACE.finditer(text, at + 1, at + step)]
            at, kind = (gaps[-1], SPACE) if gaps else (at + step, HARD)
            if at < end:
                out.append((at, kind, start))
        out.append((end, whole[end], start))
        start = end
    return out


def cut(text: str, table: bool, most: int, overlap: int, model: Model | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, kind of the cut at the end, sentences of overlap at the start) of pieces of at most `most` characters
    that cover the text. Each but the first begins with the last `overlap` sentences of the one before, whole ones (one
    that a cut runs through counts from its beginning), or fewer where these would take more than three quarters of the
    limit. Dynamic programming over the places to cut; costs: what is cut, overlap left out, and the squared distance
    from equal sizes."""
    at = places(text, ends(text, table, model), most)
    n = len(at)
    if not text:
        return []
    starts = sorted({s for _, _, s in at})
    begins = [(0, 0)]  # where a piece begins that follows a cut at the place before, and its sentences of overlap
    for end, _, _ in at:
        k = bisect_left(starts, end)
        got = next(((starts[k - o], o) for o in range(min(overlap, k), 0, -1) if end - starts[k - o] <= most - most // 4), (end, 0))
        begins.append(got)
    target = len(text) / max(1, -(-len(text) // most))
    best: list[tuple[float, int]] = [(0.0, -1)] + [(float("inf"), -1)] * n
    for j in range(1, n + 1):
        end, kind, _ = at[j - 1]
        last = CUT_COST[kind] if j < n else 0.0
        for i in range(j - 1, -1, -1):
            begin, own = begins[i]
            if i and end - at[i - 1][0] > most:
                break
            size = end - begin
            if size > most:
                continue
            less = LESS_OVERLAP * (overlap - own) if i else 0.0
            cost = best[i][0] + ((size - target) / most) ** 2 + last + less + 0.05
            if cost < best[j][0]:
                best[j] = (cost, i)
    out, j = [], n
    while j > 0:
        i = best[j][1]
        out.append((begins[i][0], at[j - 1][0], at[j - 1][1], begins[i][1] if i else 0))
        j = i
    return out[::-1]


def split_one(full: str, header: str | None, para_ids: list | None, table: bool, max_tokens: int, overlap: int, model: Model | None = None) -> list[tuple]:
    """Pieces of one chunk: (text, embed_text, n_tokens, para_ids, start, end, cut, overlap). The header is repeated before
    every piece unless it alone fills half of it; the head of a table before the pieces that continue it, likewise."""
    prefix = f"{header}\n\n" if header and full.startswith(f"{header}\n\n") else ""
    body = full[len(prefix) :]
    most = 4 * max_tokens + 3
    if 2 * len(prefix) > most:
        prefix, body = "", full
    head, head_end = "", 0
    if table and (m := _ROWS.search(body)) and 2 * (len(prefix) + len(m[1])) <= most:
        head, head_end = m[1], m.end(1)
    blocks, at = [], 0
    for m in re.finditer(r"\n\n", body):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(body)))
    ids = [p for p in para_ids or [] if p is not None]
    out = []
    for start, end, kind, repeated in cut(body, table, most - len(prefix) - len(head), overlap, model):
        part = (head if start >= head_end else "") + body[start:end]
        own = [p for p, (a, b) in zip(ids, blocks) if a < end and b > start] if len(ids) == len(blocks) else ids
        embed = prefix + part
        out.append((part, embed, max(1, len(embed) // 4), own, start, end, ("paragraph", "sentence", "space", "hard")[kind], repeated))
    return out


def split_oversized(chunks: DataFrame, max_tokens: int, overlap: int, model: Model | None = None) -> DataFrame:
    """Pieces of the chunks whose size, max(1, floor(characters / 4)) of the full text, exceeds max_tokens; see PIECES.

    Each piece with its repeated header is within the limit; `overlap` of a piece says how many sentences of the one
    before it repeats (fewer than asked for where they are too long). Sentences end where the model says. A chunk delivered twice is split once. Null or blank texts
    and chunks within the limit give no row; a null chunk_id counts as a key. Where the number of paragraphs differs
    from that of para_ids, every piece carries all of them. Other columns are ignored."""
    if max_tokens < 1 or overlap < 0:
        raise ValueError("max_tokens must be 1 at least, overlap 0 at least")
    full = full_text(chunks)
    large = chunks.select("chunk_id", F.col("context_header").alias("header"), full.alias("full"), F.coalesce(F.col("kind") == "table", F.lit(False)).alias("is_table"), F.col("para_ids").alias("ids")).filter((tokens(F.col("full")) > max_tokens) & ~blank(F.col("full")))
    large = large.dropDuplicates(["chunk_id"])
    held = chunks.sparkSession.sparkContext.broadcast((model.stats, model.weights) if model else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = Model(*held.value) if held.value else None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                for k, piece in enumerate(split_one(r["full"], r["header"], r["ids"], r["is_table"], max_tokens, overlap, ours)):
                    rows.append((r["chunk_id"], k, *piece))
            columns = list(zip(*rows)) or [[] for _ in ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)

    return spread(large, "chunk_id").mapInArrow(work, PIECES)


ARROW = pa.schema([("chunk_id", pa.string()), ("piece", pa.int32()), ("text", pa.string()), ("embed_text", pa.string()), ("n_tokens", pa.int32()), ("para_ids", pa.list_(pa.string())), ("start", pa.int32()), ("end", pa.int32()), ("cut", pa.string()), ("overlap", pa.int32())])
