"""SentencePiece encoding and decoding for BPE models, by vectorised merge rounds.

All distinct words of a batch lie in one flat array of symbols. A round finds in every word the least rank of a pair of
neighbours, merges there, and drops words in which no pair is left; rounds go on until none remains. Merges of one round are
the word's leftmost occurrence, and all its others too where no piece that could grow out of the merged one comes before it in
rank: then the order of the merges can't matter.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm import pretokens
from weft.llm.common import texts

MODEL = f"{pretokens.TOKENIZERS}/piece_bpe_32k.model"
#: BARE stands before words that have no mark; an own one of a text is never first in its word then, save after a mark.
MARK, BARE, NEVER = "▁", "\udfff", np.int32(2**31 - 1)
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
IDS = "doc_id bigint, ids array<int>"


class Pieces:
    """A model's pieces, its table of merges, and words encoded so far (forgotten at `most`, which costs time alone)."""

    def __init__(self, path: str = MODEL, most: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n, t = model.normalizer_spec, model.trainer_spec
        if t.model_type != 2 or not t.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or t.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and identity normalisation")
        self.prefix, self.most, self.kept = n.add_dummy_prefix, most, {}
        self.pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        self.text = [p.piece if k in (1, 4) else "" for p, k in zip(model.pieces, kinds)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == 6}
        self.byte_of = {i: b for b, i in self.byte.items()}
        own = {p: i for i, p in enumerate(self.pieces) if kinds[i] in (1, 4)}
        if any(MARK in p.lstrip(MARK) for p in own):
            raise ValueError("a piece reaches over the beginning of a word")
        score = np.array([p.score for p in model.pieces])
        rank = np.unique(-score, return_inverse=True)[1]
        # symbols: pieces by id, then characters that aren't pieces but occur in some, then all others as one each
        self.symbol = {c: i for c, i in own.items() if len(c) == 1}
        extra = sorted({c for p in own for c in p} - self.symbol.keys())
        self.extra = extra
        self.symbol |= {c: len(self.pieces) + i for i, c in enumerate(extra)}
        self.first_other = len(self.pieces) + len(extra)
        place = own | self.symbol
        pairs, late = [], np.zeros(len(self.pieces), bool)
        for piece, i in own.items():
            for k in range(1, len(piece)):
                a, b = place.get(piece[:k]), place.get(piece[k:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, rank[i], i))
                    for x in (a, b):
                        if x < len(late) and len(self.pieces[x]) > 1 and rank[i] <= rank[x]:
                            late[x] = True
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.rank = np.array([p[1] for p in pairs] + [NEVER], np.int32)
        self.merged = np.array([p[2] for p in pairs] + [-1], np.int32)
        self.safe = ~late

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each pair's place in the table of merges; that of none is its end."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys)) if len(self.keys) else np.zeros(len(key), np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols left of all words in order, their number in each word); a character that no piece has is
        first_other + its code point."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        some, back = np.unique(points, return_inverse=True)
        sym = np.array([self.symbol.get(chr(c), self.first_other + int(c)) for c in some], np.int64)[back]
        word = np.repeat(np.arange(len(words)), lens)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pair = np.full(len(sym), len(self.keys), np.int64)  # of each symbol and its right neighbour in the word
        inner = np.flatnonzero(word[:-1] == word[1:])
        pair[inner] = self.look(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            rank = self.rank[pair]
            least = np.minimum.reduceat(rank, starts)
            over = least == NEVER
            if over.any():
                gone = np.repeat(over, sizes)
                done.append((word[gone], sym[gone]))
                keep = ~gone
                sym, word, pair, rank = sym[keep], word[keep], pair[keep], rank[keep]
                if not len(sym):
                    break
                starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                least, sizes = least[~over], sizes[~over]
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            new_word = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            # in a run of hits next to each other every second one merges; elsewhere than at the first, safe pieces alone
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1] | new_word)
            odd = (np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 1
            hit = hit[~odd & (new_word | self.safe[self.merged[pair[hit]]])]
            sym[hit] = self.merged[pair[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[hit] = True
            changed[hit[hit > 0] - 1] = True
            # the left neighbour may have gone as the right half of another merge: its merged symbol then stands left
            gone = hit[(hit > 0)]
            gone = gone[~keep[gone - 1]]
            changed[gone - 2] = True
            sym, word, changed, pair = sym[keep], word[keep], changed[keep], pair[keep]
            at = np.flatnonzero(changed)
            pair[at] = len(self.keys)
            at = at[at + 1 < len(sym)]
            at = at[word[at] == word[at + 1]]
            pair[at] = self.look(sym[at], sym[at + 1])
        word, sym = (np.concatenate([x[k] for x in done] or [np.empty(0, np.int64)]) for k in (0, 1))
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def ids(self, words: list[str]) -> list[bytes]:
        """Each word's ids, as bytes of int32."""
        sym, n = self.merge(words)
        ends = 4 * np.cumsum(n)
        flat = sym.astype(np.int32).tobytes()
        out = [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        for w in np.unique(np.repeat(np.arange(len(words)), n)[sym >= len(self.pieces)]).tolist():
            own: list[int] = []
            for s in sym[(ends[w] >> 2) - n[w] : ends[w] >> 2].tolist():
                own += [s] if s < len(self.pieces) else [self.byte[b] for b in self.other(s).encode("utf-8", "replace")]
            out[w] = np.array(own, np.int32).tobytes()
        return out

    def other(self, s: int) -> str:
        return chr(s - self.first_other) if s >= self.first_other else self.extra[s - len(self.pieces)]

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the mark at its beginning."""
        if self.prefix and text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        words = WORD.findall((MARK if self.prefix else "") + text.replace(" ", MARK))
        return [w[1:] if w[0] == MARK else BARE + w for w in words]

    def encode(self, batch: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        cut: list[list[str]] = []
        waiting = 0
        for text in batch:
            cut.append(self.words(text) if text else [])
            waiting += len(cut[-1])
            if waiting > 200_000:  # words held at once, not a limit of any result
                out += self._joined(cut)
                cut, waiting = [], 0
        return out + self._joined(cut)

    def _joined(self, cut: list[list[str]]) -> list[np.ndarray]:
        if len(self.kept) > self.most:
            self.kept.clear()
        new = sorted({w for words in cut for w in words if w not in self.kept}, key=len)
        begin = 0
        while begin < len(new):  # long words go with few others
            end, n = begin, 0
            while end < len(new) and (n == 0 or n + len(new[end]) <= 100_000):
                n += len(new[end]) + 1
                end += 1
            some = new[begin:end]
            self.kept.update(zip(some, self.ids([w[1:] if w[:1] == BARE else MARK + w for w in some])))
            begin = end
        return [np.frombuffer(b"".join(map(self.kept.__getitem__, words)), np.int32) for words in cut]

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, control and unknown pieces nothing."""
        parts: list[bytes] = []
        for i in ids:
            parts.append(bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].encode("utf-8", "surrogatepass"))
        text = b"".join(parts).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


@cache
def pieces(path: str = MODEL) -> Pieces:
    return Pieces(path)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]), pa.int32()))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids) for every row of docs, as the SentencePiece library encodes its text with that BPE model.

    Null and empty texts have no ids. A repeated row gives a row each time, a null doc_id stays null, an empty table gives an
    empty one; columns other than doc_id and text aren't read. A narrow pass: no shuffle.
    """

    def run(batches):
        own = pieces(model)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                yield pa.record_batch([part["doc_id"], _lists(own.encode(part["text"].to_pylist()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, IDS)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids are a null text."""

    def run(batches):
        own = pieces(model)
        for batch in batches:
            text = [None if x is None else own.decode(x) for x in batch["ids"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
