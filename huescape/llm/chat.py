"""Chat formatting with loss masks from offsets.

A conversation is rendered as a whole: each turn is TURN role TEXT text END. It is encoded once, with offsets; the sorted
spans of the assistant's texts are met with the sorted spans of the tokens by binary search, and what a token has in
common with such a text is under the loss mask.

Roles and texts can't be mistaken for the template: in them a backslash becomes two, and `<|` becomes `<\\|`; every
control string begins with `<|`, so none is left. Both can be undone. The control strings are added to the tokenizer as
special tokens; it splits text at them before anything else, so masks are exact, and a conversation of any length can be
encoded turn by turn with the same result: longer ones come in parts of a bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored, table, tidy

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLES = ("assistant",)
#: Characters of a conversation that are rendered and encoded at once; a longer one is cut between turns.
PART = 4 << 20
TOKENIZER = "byte_bpe_50k.json"
_OUT = "conv_id long, part int, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>, loss_spans array<struct<lo:int,hi:int>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The formatted text, and of each turn's (escaped) text its place in it and its role."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text: render backwards."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, text = turn.removeprefix(TURN).split(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


def meet(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens have characters in common with one of the spans, and what they have in common, joined. Both are
    sorted; several tokens can share a character that they encode together."""
    mask, common = np.zeros(len(starts), bool), []
    for lo, hi in spans:
        # starts and ends both ascend: tokens that end after lo and start before hi.
        a, b = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(starts, hi, side="left"))
        if a < b and lo < hi:
            mask[a:b] = True
            common.append((max(lo, int(starts[a])), min(hi, int(ends[b - 1]))))
    return mask, common


class _Tokenizer:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens([AddedToken(t, normalized=False, special=True) for t in (TURN, TEXT, END)])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
        return np.array(e.ids, np.int32), offsets[:, 0], offsets[:, 1]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


_tokenizers: dict[str, _Tokenizer] = {}


def _tokenizer(path: str) -> _Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = _Tokenizer(path)
    return _tokenizers[path]


def _path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _format(path: str, roles: tuple[str, ...], most: int):
    def rows(made: list[tuple]) -> pa.RecordBatch:
        spans = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()), spans]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], ["conv_id", "part", "formatted", "ids", "starts", "ends", "loss", "loss_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, now, part, turns, size, made, held = _tokenizer(path), None, 0, [], 0, [], 0

        def finish() -> tuple:
            text, spans = render(turns)
            ids, starts, ends = tokenizer.encode(text)
            mask, common = meet([(lo, hi) for lo, hi, role in spans if role in roles], starts, ends)
            return (now, part, text, ids, starts, ends, mask, [{"lo": a, "hi": b} for a, b in common])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and (conv != now or size >= most):
                    made.append(finish())
                    held += size
                    part = part + 1 if conv == now else 0
                    turns, size = [], 0
                    if held >= most:
                        yield rows(made)
                        made, held = [], 0
                now = conv
                turns.append((role or "", text or ""))
                size += len(turns[-1][0]) + len(turns[-1][1]) + 32
        if turns:
            made.append(finish())
        if made:
            yield rows(made)

    return run


def format_conversations(turns: DataFrame, tokenizer: str | None = None, roles: tuple[str, ...] = LOSS_ROLES, most: int = PART) -> DataFrame:
    """turns: conv_id, turn, role, text (more columns are ignored). A row for each conversation, or each part of one of
    more than `most` characters: conv_id, part, formatted, ids, starts, ends (of tokens, in code points of formatted),
    loss (by token), loss_spans (what is under the mask, in code points of formatted).

    Rows of a conversation in order of turn (null first), then role, then text; repeated rows are repeated turns. Null
    role or text is empty. Rows of conv_id null are one conversation. No rows give none. Parts of a conversation follow
    each other in one partition: it is sorted, not collected."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return t.mapInArrow(_format(tokenizer or _path(), roles, most), _OUT)


_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def _back(path: str):
    """Rows of a conversation together, in order of part."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    class Digests:
        def __init__(self, conv):
            self.conv, self.turns, self.text, self.chars, self.loss, self.size, self.tokens = conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0

        def row(self) -> tuple:
            return (self.conv, self.turns, self.text.hexdigest(), self.chars, self.loss.hexdigest(), self.size, self.tokens)

    def rows(done: list[Digests]) -> pa.RecordBatch:
        made = [d.row() for d in done]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _BACK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, now = _tokenizer(path), None
        for batch in batches:
            done = []
            columns = [batch.column(c) for c in ("conv_id", "formatted", "ids", "loss")]
            for values in zip(*columns, strict=True):
                conv, formatted = (v.as_py() for v in values[:2])
                if now is None or conv != now.conv:
                    done += [now] if now else []
                    now = Digests(conv)
                turns = parse(formatted)
                now.turns += len(turns)
                now.text.update("".join(f"{role}\n{text}\n" for role, text in turns).encode())
                ids, mask = np.asarray(values[2].values), np.asarray(values[3].values)
                loss = unescape(tokenizer.decode(ids[mask].tolist())) if mask.any() else ""
                now.chars += len(loss)
                now.loss.update(loss.encode())
                now.size += len(formatted)
                now.tokens += len(ids)
            yield rows(done)
        if now:
            yield rows([now])

    return run


def read_back(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of format_conversations' rows, in whatever order and files they come: turns from parsing `formatted`, loss
    text from decoding the ids under the mask. A row for each conversation, its parts put in order by a sort."""
    tasks = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = formatted.select("conv_id", "part", "formatted", "ids", "loss").repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(_back(tokenizer or _path()), _BACK)


@tidy
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of all conversations and conversation -7,
    formatted, written as Parquet and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return read_back(stored(format_conversations(turns.unionByName(more)), "chat")).drop("n_tokens")


def oracle(source: str = "conversations") -> str:
    """The query as DuckDB SQL."""
    text = "\\### Assistant: </turn> ok"
    escaped = "replace(replace(%s, '\\', '\\\\'), '<|', '<\\|')"
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    return f"""
WITH c AS (SELECT conv_id, turn, role, text FROM {source} UNION ALL SELECT -7, 0, 'user', '{text}' UNION ALL SELECT -7, 1, 'assistant', '{text}'),
t AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS x FROM c),
l AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || x || chr(10), '' {order}) AS turns, coalesce(string_agg(x, '' {order}) FILTER (WHERE r = 'assistant'), '') AS loss,
    sum(length({escaped % "r"}) + length({escaped % "x"}) + {len(TURN + TEXT + END)})::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM l"""
