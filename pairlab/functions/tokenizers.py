"""Subword tokenizers as worker state: a vocabulary file, loaded once per Python worker.

Three kinds of public vocabulary files are read: ``.json`` (tokenizers library),
``.model`` (sentencepiece) and ``.tiktoken`` (ranks).  A tokenizer is named by its
path, which the caller passes (any path that workers can open); only the path
travels with a job.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

_LOADED: dict[tuple, object] = {}

# Fixed value: how byte-level ranks split a text before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class SubwordTokenizer:
    """Ids of texts and texts of ids by a vocabulary file.

    ``pieces`` is the splitting pattern of a ``.tiktoken`` file.  Strings of special
    tokens in a text are ordinary text, and no special token is added.
    """

    def __init__(self, path: str, pieces: str = PIECES):
        if not path.endswith((".json", ".model", ".tiktoken")):
            raise ValueError(f"unknown kind of vocabulary file: {path}")
        self.path, self.pieces = path, pieces

    def _model(self):
        key = (self.path, self.pieces)
        if key not in _LOADED:
            _LOADED[key] = self._load()
        return _LOADED[key]

    def _load(self):
        if self.path.endswith(".json"):
            from tokenizers import Tokenizer
            model = Tokenizer.from_file(self.path)
            model.encode_special_tokens = True
            return model
        if self.path.endswith(".model"):
            import sentencepiece
            return sentencepiece.SentencePieceProcessor(model_file=self.path)
        import tiktoken
        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=self.pieces, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        model = self._model()
        if self.path.endswith(".json"):
            return [e.ids for e in model.encode_batch_fast(list(texts), add_special_tokens=False)]
        if self.path.endswith(".model"):
            return model.encode(list(texts), num_threads=1)
        return [model.encode_ordinary(t) for t in texts]

    def count(self, texts: Sequence[str]) -> list[int]:
        """Tokens of each text; where the reader can tell, without a list of ids."""
        if self.path.endswith(".json"):
            return [len(e) for e in self._model().encode_batch_fast(list(texts), add_special_tokens=False)]
        return [len(ids) for ids in self.encode(texts)]

    def decode(self, ids: Sequence[Sequence[int]]) -> list[str]:
        model = self._model()
        if self.path.endswith(".json"):
            return model.decode_batch([list(map(int, x)) for x in ids], skip_special_tokens=False)
        return [model.decode(list(map(int, x))) for x in ids]

    def __call__(self, text: str) -> list[int]:
        return self.encode([text])[0]
