"""Token ids of whole texts from the tokenizers library, piece by piece.

Where a vocabulary drops white space and keeps letter runs, digits and other
characters apart, the ids of a text are those of its pieces, end to end.  The
library then encodes each distinct piece once and numpy puts the texts
together, several times faster than encoding texts and with the same ids.
Other vocabularies are encoded text by text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from accesslens.llm.words import Text, gather, split_pieces

#: Distinct pieces remembered by one Python worker: those met since the last
#: clearing, and as many from before it.
REMEMBERED = 200_000
#: Pieces that the library gets in one string.
JOINED = 256
END = "</w>"
#: The splitting pattern that pieces are cut for (fixed value of the vocabulary file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = re.compile(rb"(?:[!-&(-;=-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z")


@lru_cache(maxsize=2)
def encoder(path: str) -> "Encoder":
    return Encoder(path)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as source:
            parts = json.load(source)
        steps = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        model = parts["model"]
        special = all(token["content"].startswith("<") and not (token["lstrip"] or token["rstrip"]) for token in parts["added_tokens"])
        self.by_piece = bool(steps) and steps[0].get("pattern") == {"Regex": PATTERN} and model.get("end_of_word_suffix") == END and special
        if self.by_piece:
            self.ends = np.zeros(self.library.get_vocab_size(), bool)
            self.ends[[i for token, i in model["vocab"].items() if token.endswith(END)]] = True
            # Plain pieces are lower-case and cut already: the same model without those steps.
            parts |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}}
            self.model = Tokenizer.from_str(json.dumps(parts))
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _plain(self, texts: list[str], library=None) -> list[bytes]:
        found = (library or self.library).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(item.ids, "<u4").tobytes() for item in found]

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit numbers.

        Plain pieces are joined by blanks; the last id of each ends a word.
        """
        out = dict.fromkeys(pieces, b"")
        plain, rest = [], []
        for piece in pieces:
            (plain if PIECE.match(piece) else rest).append(piece)
        out.update(zip(rest, self._plain([piece.decode("utf-8", "replace") for piece in rest]), strict=True))
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for at in range(0, len(groups), 16):
            joined = self._plain([b" ".join(group).decode() for group in groups[at : at + 16]], self.model)
            for group, data in zip(groups[at : at + 16], joined, strict=True):
                cuts = (np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1) * 4
                begin = 0
                for piece, end in zip(group, cuts.tolist(), strict=True):
                    out[piece] = data[begin:end]
                    begin = end
        return list(out.values())

    def _blobs(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        blobs = list(map(known.get, pieces))
        absent = [at for at, blob in enumerate(blobs) if blob is None]
        missing = []
        for at in absent:
            blob = older.get(pieces[at])
            if blob is None:
                missing.append(at)
            else:
                blobs[at] = known[pieces[at]] = blob
        for at, blob in zip(missing, self._ids_of([pieces[at] for at in missing]), strict=True):
            blobs[at] = known[pieces[at]] = blob
        return blobs

    def encode(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        if not self.by_piece:
            blobs = self._plain([text.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(text.offsets[:-1], text.offsets[1:], strict=True)])
            return np.frombuffer(b"".join(blobs), "<u4"), np.array([len(x) // 4 for x in blobs], np.int64)
        words = split_pieces(text)
        blobs = self._blobs(words.uniques)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        flat = np.frombuffer(b"".join(blobs), "<u4")
        each = sizes[words.codes]
        ids = flat[gather((np.cumsum(sizes) - sizes)[words.codes], each)]
        ends = np.concatenate(([0], np.cumsum(each)))
        return ids, np.diff(ends[words.first])
