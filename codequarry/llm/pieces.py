"""SentencePiece BPE encoding and decoding by a table of prefixes' last tokens.

In a merge-type vocabulary each prefix of a text has one encoding, so one last
token. An automaton reads the text and gives, at each place, the pieces that end
there; the last token of the prefix is the one of them that may stand after the last
token of what comes before it. Two tokens may stand side by side if encoding their
concatenation by merges gives them back. From the end of the text the table then gives the
ids backwards, in time that grows with the text alone.

Where no piece holds two characters side by side, no merge can join them, so a text
falls into chunks there (words, runs of other signs) that are encoded one by one. Each
chunk is encoded once for a step of text: the distinct new ones are sorted, and a
chunk keeps the part of the table that it shares with the one before it.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import read, steps
from codequarry.ship import map_arrow

SPACE = "▁"
#: Chunks whose encodings a worker keeps, and characters of those and their encodings. They bound memory and change no result.
KEPT, KEPT_CHARS = 250_000, 32_000_000
_NONE = float("-inf")


def _merged(text: str, score: dict[str, float]) -> list[str]:
    """Encoding by definition: again and again the best-scored pair of neighbours merges, the leftmost of equal ones."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class PrefixTable:
    """Encoder and decoder of one model. Pickles as the vocabulary; automaton and memos are made in each worker."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        kind = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.surface = ["" if model.is_control(i) else model.id_to_piece(i).replace(SPACE, " ") for i in range(n)]
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_range = min(self.byte_ids.values(), default=0), max(self.byte_ids.values(), default=0)
        if len(self.byte_ids) != 256 or self.byte_range[1] - self.byte_range[0] != 255:
            raise ValueError("the model needs a piece for each byte, side by side")
        self.score = {model.id_to_piece(i).replace(SPACE, " "): model.get_score(i) for i in range(n) if not kind[i] and not model.is_byte(i)}
        self.ids = {model.id_to_piece(i).replace(SPACE, " "): i for i in range(n) if not kind[i] and not model.is_byte(i)}
        # pieces that merges can make; others never occur in an encoding
        self.pieces = [p for p in self.ids if len(p) == 1 or _merged(p, self.score) == [p]]
        self.pattern = self._chunks()

    def _chunks(self) -> str:
        """A pattern that splits only where no piece crosses, by the vocabulary itself."""
        extra = ""
        for _ in range(len(self.pieces)):
            odd = re.escape(extra)
            pattern = rf" *[^\W\d_{odd}]+| *(?:[^\w ]+|[\d_{odd}]+)+| +"
            test = re.compile(pattern)
            bad = next((p for p in self.pieces if not test.fullmatch(p)), None)
            if bad is None:
                return pattern
            new = [c for c in bad if re.fullmatch(r"[^\W\d_]", c) and c not in extra]
            if not new or len(extra) > 64:
                return r" *[^ ]+| +"  # words mix with other signs: split at spaces only
            extra += new[0]
        return r" *[^ ]+| +"

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_m_")}

    def _ready(self) -> None:
        """The automaton: for each state its moves, and what ends there as (token, length), longest first."""
        if hasattr(self, "_m_move"):
            return
        names, move, out, token = list(self.pieces), [{}], [()], {}
        for p in names:
            state = 0
            for c in p:
                to = move[state].get(c)
                if to is None:
                    to = move[state][c] = len(move)
                    move.append({})
                    out.append(())
                state = to
            token[p] = self.ids[p]
            out[state] = ((self.ids[p], len(p)),)
        fail, todo = [0] * len(move), list(move[0].values())
        for s in todo:  # breadth first
            for c, to in move[s].items():
                f = fail[s]
                while f and c not in move[f]:
                    f = fail[f]
                f = move[f].get(c, 0)
                fail[to] = f if f != to else 0
                todo.append(to)
            out[s] = out[s] + out[fail[s]]
        self._m_move, self._m_fail, self._m_out = move, fail, out
        self._m_name = {i: p for p, i in token.items()}
        self._m_pair: dict[int, bool] = {}
        self._m_story: dict[int, list[tuple[float, str, str]]] = {}
        self._m_text: dict[str, str] = {}
        self._m_back: dict[str, str] = {}
        self._m_chars = 0
        self._m_find = re.compile(self.pattern).findall

    def _step(self, state: int, c: str) -> int:
        move, fail = self._m_move, self._m_fail
        s = state
        while s and c not in move[s]:
            s = fail[s]
        to = move[s].get(c, 0)
        if state:
            move[state][c] = to  # remembered as a move of its own
        return to

    def _story(self, token: int) -> list[tuple[float, str, str]]:
        """How a token comes about by itself: before each merge, that merge's score and the first and last part."""
        found = self._m_story.get(token)
        if found is None:
            parts, found, get = list(self._m_name[token]), [], self.score.get
            scores = [get(x + y, _NONE) for x, y in zip(parts, parts[1:])]
            while scores:
                best = max(scores)
                at = scores.index(best)
                found.append((best, parts[0], parts[-1]))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del scores[at]
                if at:
                    scores[at - 1] = get(parts[at - 1] + parts[at], _NONE)
                if at < len(scores):
                    scores[at] = get(parts[at] + parts[at + 1], _NONE)
            found.append((_NONE, parts[0], parts[-1]))
            self._m_story[token] = found
        return found

    def _beside(self, a: int, b: int) -> bool:
        """Whether no merge crosses from a to b while both come about, the best score and then the leftmost first."""
        x, y, score = self._story(a), self._story(b), self.score
        i = j = 0
        while True:
            (sx, _, px), (sy, py, _) = x[i], y[j]
            across = score.get(px + py, _NONE)
            if across > sx and across >= sy and across > _NONE:
                return False
            if sx == sy == _NONE:
                return True
            if sx >= sy:
                i += 1
            else:
                j += 1

    def encode_sorted(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each of some sorted chunks."""
        self._ready()
        move, out, pair = self._m_move, self._m_out, self._m_pair
        states, last, size = [0], [0], [0]
        before, found = "", []
        for text in chunks:
            n, k = len(text), 0
            for a, b in zip(before, text):
                if a != b:
                    break
                k += 1
            del states[k + 1 :], last[k + 1 :], size[k + 1 :]
            state = states[k]
            for i in range(k + 1, n + 1):
                c = text[i - 1]
                to = move[state].get(c)
                state = self._step(state, c) if to is None else to
                for t, length in out[state]:
                    j = i - length
                    if j:
                        p = last[j]
                        if p >= 0:
                            key = p << 20 | t
                            ok = pair.get(key)
                            if ok is None:
                                ok = pair[key] = self._beside(p, t)
                            if not ok:
                                continue
                    break
                else:
                    t, length = -1, 1  # a character that the vocabulary lacks
                states.append(state)
                last.append(t)
                size.append(length)
            ids, i = [], n
            while i:
                t = last[i]
                if t >= 0:
                    ids.append(t)
                else:
                    ids += [self.byte_ids[b] for b in reversed(text[i - 1].encode())]
                i -= size[i]
            ids.reverse()
            found.append(ids)
            before = text
        return found

    def pieces_of(self, ids: list[int]) -> str:
        """Text of ids, bytes in a run decoded together, as the library does, without regard to the text's start."""
        parts, run = [], bytearray()
        low, high = self.byte_range
        for i in [*ids, -1]:
            if low <= i <= high:
                run.append(int(self.surface[i][3:-1], 16))
                continue
            if run:
                parts.append(_utf8(bytes(run)))
                run.clear()
            if i >= 0:
                parts.append(self.surface[i])
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        """Text of whole ids: one space goes from the first piece's front."""
        if not ids:
            return ""
        text = self.pieces_of(ids)
        first = self.surface[ids[0]]
        return text[1:] if first.startswith(" ") else text

    def learn(self, texts: list[str]) -> list[list[str]]:
        """Chunks of each text, all of whose encodings are then in the memo."""
        self._ready()
        if len(self._m_text) > KEPT or self._m_chars > KEPT_CHARS:
            self._m_text.clear()
            self._m_back.clear()
            self._m_chars = 0
        if len(self._m_pair) > 4 * KEPT:
            self._m_pair.clear()
        find = self._m_find
        rows = [find(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        known = self._m_text
        new = sorted({c for c in set(chain.from_iterable(rows)) if c not in known})
        for c, ids in zip(new, self.encode_sorted(new)):
            known[c] = ",".join(map(str, ids))
            back = self.pieces_of(ids)
            self._m_back[c] = c if back == c else back
            self._m_chars += len(c) + len(known[c]) + (0 if back == c else len(back))
        return rows

    def both(self, texts: list[str]) -> list[tuple[str, str]]:
        """Ids joined by commas, and the text they decode to."""
        rows, known, back = self.learn(texts), self._m_text, self._m_back
        out = []
        for r in rows:
            ids = ",".join([known[c] for c in r])
            text = "".join([back[c] for c in r])
            out.append((ids, text[1:] if text[:1] == " " else text))
        return out


def _utf8(raw: bytes) -> str:
    """Valid characters as such, each other byte as U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def _default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _run(df: DataFrame, model_file: str | None, text_col: str, made, schema: str) -> DataFrame:
    """Adds what made(table, texts) gives for each row."""
    table = df.sparkSession.sparkContext.broadcast(PrefixTable(model_file or _default_model()))

    def run(batches):
        names = None
        for batch in batches:
            for part in steps(batch, text_col):
                new = made(table.value, [t or "" for t in part.column(text_col).to_pylist()])
                names = names or [*part.schema.names, *new]
                yield pa.RecordBatch.from_arrays([*part.columns, *new.values()], names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_arrow(df, run, f"{kept}, {schema}")


def encode(docs: DataFrame, *, text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """All columns of docs and ids, an array of int, without begin or end ids.

    Null and empty texts have no ids. A column of docs named ids is replaced.
    """

    def made(table, texts):
        rows, known = table.learn(texts), table._m_text
        return {"ids": pa.array([[int(x) for c in r for x in known[c].split(",")] for r in rows], pa.list_(pa.int32()))}

    return _run(docs.drop("ids"), model_file, text_col, made, "ids array<int>")


def decode(rows: DataFrame, *, ids_col: str = "ids", to: str = "text", model_file: str | None = None) -> DataFrame:
    """All columns of rows and the text of ids_col; null ids give an empty text. A column named as the result is replaced."""
    table = rows.sparkSession.sparkContext.broadcast(PrefixTable(model_file or _default_model()))
    rows = rows.drop(to)

    def run(batches):
        for batch in batches:
            texts = [table.value.decode(ids or []) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, to])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_arrow(rows, run, f"{kept}, `{to}` string")


def _digests(table, texts):
    pairs = table.both(texts)
    sha = hashlib.sha256
    return {
        "__cq_n": pa.array([ids.count(",") + 1 if ids else 0 for ids, _ in pairs], pa.int64()),
        "__cq_ids": pa.array([sha(ids.encode()).hexdigest() for ids, _ in pairs]),
        "__cq_back": pa.array([sha(text.encode()).hexdigest() for _, text in pairs]),
    }


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text, for each row; null text is empty."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("__cq_text"))
    out = _run(narrow, model_file, "__cq_text", _digests, "__cq_n long, __cq_ids string, __cq_back string")
    return out.select("doc_id", F.col("__cq_n").alias("n_tokens"), F.col("__cq_ids").alias("ids_sha256"), F.col("__cq_back").alias("decoded_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with their number and digests of both directions: doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256."""
    out = _run(docs.select("doc_id", "lang", "source", "text"), None, "text", _digests, "__cq_n long, __cq_ids string, __cq_back string")
    return out.select("doc_id", "lang", "source", F.col("__cq_n").alias("n_tokens"), F.col("__cq_ids").alias("ids_sha256"), F.col("__cq_back").alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
