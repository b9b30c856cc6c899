"""A sentencepiece model as tables: pieces, their ranks, byte fallback, and where texts may be cut."""

from __future__ import annotations

import numpy as np

SPACE = "▁"


class Pieces:
    """The vocabulary of one sentencepiece model file, loaded once per process.

    ``ids`` maps a piece to its id and each proper tail of a piece to -1, so a
    walk back from a position ends as soon as no piece can end there.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.size = size
        self.text: list[str | None] = [None] * size
        self.score = [0.0] * size
        self.byte_id = [-1] * 256
        self.byte_of: dict[int, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.byte_of[i] = value
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = piece
                self.score[i] = model.get_score(i)
        if min(self.byte_id) < 0:
            raise ValueError("the model has no byte fallback")
        words = {p: i for i, p in enumerate(self.text) if p is not None}
        self.ids: dict[str, int] = dict(words)
        for piece in words:
            for k in range(1, len(piece)):
                self.ids.setdefault(piece[k:], -1)
        # Merges build pieces from neighbours, so nothing reaches across two characters that no piece holds side by side.
        pairs = {p[k:k + 2] for p in words for k in range(len(p) - 1)}
        chars = sorted(set("".join(pairs)))
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        keys = np.array([self.number[ord(x)] * self.width + self.number[ord(y)] for x, y in pairs], np.int64)
        #: The pairs as a table, or as sorted keys where a vocabulary has too many characters for one.
        self.beside = np.sort(keys) if self.width > 4096 else np.bincount(keys, minlength=self.width ** 2).astype(bool)

    def apart(self, chars: np.ndarray) -> np.ndarray:
        """Whether each character but the first can be cut from the one before it."""
        numbers = self.number[chars].astype(np.int64)
        keys = numbers[:-1] * self.width + numbers[1:]
        if self.beside.dtype == bool:
            return ~self.beside[keys]
        at = np.minimum(np.searchsorted(self.beside, keys), len(self.beside) - 1)
        return self.beside[at] != keys

    def chunks(self, text: str) -> list[str]:
        """The marked text in parts that no piece crosses; none for an empty text."""
        if not text:
            return []
        whole = SPACE + text.replace(" ", SPACE)
        begin = cut_parts(whole, np.array([len(whole)]), self)[0].tolist()
        return [whole[a:b] for a, b in zip(begin, [*begin[1:], len(whole)])]


def cut_parts(whole: str, lengths: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of joined marked texts begin, and how many parts each text has."""
    chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(len(chars), bool)
    ends = np.cumsum(lengths)
    first[(ends - lengths)[lengths > 0]] = True
    if len(chars) > 1:
        first[1:] |= pieces.apart(chars)
    begin = np.flatnonzero(first)
    return begin, np.diff(np.searchsorted(begin, np.concatenate([[0], ends])))


def load_pieces(path: str, store: dict) -> Pieces:
    key = ("pieces", path)
    if key not in store:
        store[key] = Pieces(path)
    return store[key]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer files of this machine lie."""
    import public_tokenizers

    return public_tokenizers.path(name)
