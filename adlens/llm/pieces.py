"""SentencePiece encoding and decoding of merge-type models by a prefix table.

For every prefix of a text, the encoding of that prefix ends in exactly one token. The table holds
the length of that token: among the pieces an automaton finds to end at a position, it is the one
that is compatible with the last token of the prefix before it, where two tokens are compatible if
merging their joined text by priority gives just these two. The ids follow from the table by
walking back from the end. No merge queue is run over the text, and the work is linear in it.

No piece holds a space mark behind another character, so words never merge with the word before
them; each worker remembers the ids of short words it has met.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import sys
import types
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark that stands for a space; a fixed value of the format.
SPACE = "▁"
#: Kinds of pieces in a model file; fixed values of the format.
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Words a worker remembers at most, longest word it remembers, and pairs it remembers.
WORDS, WORD_CHARS, PAIRS = 400_000, 48, 1_000_000
#: Largest model file that is sent to the executors.
MODEL_BYTES = 32 << 20


class _Runs(dict):
    """Ids of runs of characters, worked out on first use. Those not asked for lately are forgotten.

    ``start`` is put before a run unless it begins with a line break, which stands for itself. A
    run is cut where no piece holds the two neighbouring characters: no merge can cross there.
    """

    def __init__(self, model: "PieceModel", start: str):
        self.model, self.start, self.before = model, start, {}

    def __missing__(self, word: str) -> str:
        ids = self.before.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _ids(self, word: str) -> str:
        model = self.model
        run = word if word[:1] == "\n" else self.start + word
        first = len(run) - len(word)
        cuts = [i for i in range(first + 1, len(run)) if run[i - 1 : i + 1] not in model.joined]
        if not cuts:
            return " ".join(map(str, model.encode_run(run)))
        parts = [self[word[: cuts[0] - first]]]
        parts += [model.bare[run[a:b]] for a, b in zip(cuts, cuts[1:] + [len(run)])]
        return " ".join(parts)


class PieceModel:
    """The tables of one model, built from the bytes of its file."""

    def __init__(self, proto: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(proto)
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only merge-type models without character rewriting are supported")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        kinds = [p.type for p in model.pieces]
        self.end = model.trainer_spec.eos_id
        self.unknown = kinds.index(UNKNOWN)
        self.byte_ids = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.byte_fallback = BYTE in kinds
        self.text = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if kinds[i] == NORMAL}
        if len(self.ids) + kinds.count(BYTE) + sum(k in (2, 3) for k in kinds) != len(kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that span words are not supported")
        self.early = {p: -model.pieces[i].score for p, i in self.ids.items()}
        self.lines = not any("\n" in p for p in self.ids)
        self.parts = {}
        for piece in sorted(self.ids, key=len):
            self._merge_tree(piece)
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if piece in self.parts:
                self.automaton.add_word(piece, (self.ids[piece], len(piece)))
        self.automaton.make_automaton()
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}
        self.words, self.bare = _Runs(self, SPACE), _Runs(self, "")
        # What an id adds to a decoded text, as bytes; ids other than pieces and bytes add nothing.
        self.spelled = {}
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.spelled[str(i)] = bytes([int(p.piece[3:5], 16)])
            elif p.type == NORMAL:
                self.spelled[str(i)] = p.piece.replace(SPACE, " ").encode()
            else:
                self.spelled[str(i)] = b" \xe2\x81\x87 " if p.type == UNKNOWN else b""

    def _merge_tree(self, piece: str) -> None:
        """Note the last merge that makes ``piece``; a piece no merge makes can't be a token."""
        symbols = list(piece)
        while len(symbols) > 1:
            best = min(
                (self.early.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
            )
            if best[0] == float("inf"):
                return
            i = best[1]
            if len(symbols) == 2:
                self.parts[piece] = (symbols[0], symbols[1])
                return
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        self.parts[piece] = None

    def compatible(self, left: str, right: str) -> bool:
        """Whether the border between two tokens survives all merges around it.

        Goes back in time: of the two tokens at the border the one made later is taken apart, and
        at each moment no merge across the border may come before the merge just undone. Of merges
        with equal priority the one further left comes first.
        """
        early, parts = self.early, self.parts
        limit, left_loses = float("inf"), False
        while True:
            across = early.get(left + right)
            if across is not None and (across < limit or (across == limit and left_loses)):
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and early[left] > early[right]):
                limit, left_loses, left = early[left], False, a[1]
            else:
                limit, left_loses, right = early[right], True, b[0]

    def encode_run(self, run: str) -> list[int]:
        """Ids of a text whose spaces are marks already."""
        size = len(run)
        last = [-1] * size
        pairs, shift = self.pairs, len(self.text).bit_length()
        fits_known = pairs.get
        for end, (token, length) in self.automaton.iter(run):
            if last[end] >= 0:
                continue
            before = last[end - length] if length <= end else -1
            if before >= 0:  # else the text begins here, or an unknown character, which never merges
                pair = before << shift | token
                fits = fits_known(pair)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.compatible(self.text[before], self.text[token])
                if not fits:
                    continue
            last[end] = token
        out, end = [], size - 1
        while end >= 0:
            token = last[end]
            if token >= 0:
                out.append(token)
                end -= len(self.text[token])
                continue
            if self.byte_fallback:
                out.extend(self.byte_ids[b] for b in reversed(run[end].encode()))
            else:
                out.append(self.unknown)
            end -= 1
        out.reverse()
        return out

    def encode(self, text: str) -> str:
        """The ids of ``text`` and the end id, decimal, joined by spaces."""
        if not text:
            return str(self.end)
        if (
            not self.prefix or not self.lines or SPACE in text or "  " in text or " \n" in text
            or text[0] == " "
        ):
            marked = self.prefix + text.replace(" ", SPACE)
            parts = []
            for run in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked):
                single = run[:1] == SPACE and run[1:2] not in (SPACE, "\n")
                parts.append(self.words[run[1:]] if single else " ".join(map(str, self.encode_run(run))))
        else:
            parts = list(map(self.words.__getitem__, text.replace("\n", " \n").split(" ")))
        return " ".join(parts) + f" {self.end}"

    def decode(self, ids: str) -> str:
        """The text of ids in the form ``encode`` gives."""
        if not ids:
            return ""
        one_by_one = ids.split(" ")
        spelled = list(map(self.spelled.__getitem__, one_by_one))
        if b"" in spelled[:-1]:  # a control id ends a run of bytes
            runs = "".join("x" if p else " " for p in spelled).split()
            pieces = iter([p for p in spelled if p])
            text = "".join(b"".join(islice(pieces, len(r))).decode("utf-8", "sign_per_byte") for r in runs)
        else:
            text = b"".join(spelled).decode("utf-8", "sign_per_byte")
        first = next((i for i, p in zip(one_by_one, spelled) if p), None)
        strip = self.prefix and first is not None and self.text[int(first)].startswith(self.prefix)
        return text[1:] if strip else text


def _signs(error: UnicodeDecodeError) -> tuple[str, int]:
    """Each byte that is no part of a character becomes one replacement sign."""
    return "\ufffd" * (error.end - error.start), error.end


codecs.register_error("sign_per_byte", _signs)



def _model(proto: bytes) -> PieceModel:
    """One model per worker process, kept between tasks."""
    kept = sys.modules.setdefault("_adlens_models", types.ModuleType("_adlens_models")).__dict__
    name = "model_" + hashlib.sha256(proto).hexdigest()
    if name not in kept:
        codecs.register_error("sign_per_byte", _signs)
        kept[name] = PieceModel(proto)
    return kept[name]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        proto = file.read(MODEL_BYTES + 1)
    if len(proto) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return proto


def with_ids(docs: DataFrame, model_path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of the text as an array, end id included.

    The ids are those of the library's ``encode`` with an end id and no sampling. Null is encoded
    as empty text. Long texts are encoded whole.
    """
    proto = read_model(model_path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(proto)
        for batch in batches:
            yield batch.fillna("").map(lambda t: list(map(int, model.encode(t).split(" "))))

    return docs.withColumn(out, ids(F.col(f"`{text}`")))


def with_text(docs: DataFrame, model_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text that an array of ids stands for; null ids give an empty text."""
    proto = read_model(model_path)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(proto)
        for batch in batches:
            yield batch.map(lambda a: model.decode(" ".join(map(str, a)) if a is not None else ""))

    return docs.withColumn(out, decoded(F.col(f"`{ids}`")))


def digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256, decoded_sha256.

    Encodes each text, decodes the ids and keeps only digests, so no array of ids leaves the worker.
    Repeated rows give repeated rows; a null text counts as empty; an empty table stays empty.
    """
    proto = read_model(model_path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(proto)
        for batch in batches:
            rows = []
            for one in batch:
                ids = model.encode(one or "")
                back = model.decode(ids)
                rows.append((
                    ids.count(" ") + 1,
                    hashlib.sha256(ids.encode()).hexdigest(),
                    hashlib.sha256(back.encode()).hexdigest(),
                ))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(f"`{key}`").alias(key), digest(F.col(f"`{text}`")).alias("d")).select(f"`{key}`", "d.*")
