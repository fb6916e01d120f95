"""Token ids of texts by a public tokenizer, with the ids of words remembered.

Ids come from the tokenizers library alone.  As prose repeats its words, a
text is cut where the tokenizer itself always cuts and the library encodes the
pieces not met before, many of them as one text: a mark stands between them
that is always an id of its own, and where its ids do not come out as often as
it was set, each piece is encoded alone.  Ids are put together as little-endian
32-bit bytes.  Texts that could cut differently (runs of white space, odd
separators) are encoded whole.  Special tokens' strings in a text are ordinary
text.
"""

import os
import re
from collections.abc import Collection

import numpy as np

#: Bytes of each of the two generations that a worker remembers, pieces and ids with what Python needs around them.
REMEMBERED_BYTES, _AROUND = 24_000_000, 200
#: Pieces encoded as one text.
_JOINED = 200


class _Known(dict):
    """Ids of pieces.

    When there are too many, they become the old generation, and only those met again come back from it.
    """

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.size = 0

    def missing(self, pieces: set[str]) -> list[str]:
        """The pieces that neither generation has; those of the old one come back."""
        absent = pieces.difference(self)
        again = absent.intersection(self.old)
        self.add(again, [self.old[p] for p in again])
        return list(absent.difference(again))

    def add(self, pieces: Collection[str], ids: list[bytes]) -> None:
        self.update(zip(pieces, ids))
        self.size += 2 * sum(map(len, pieces)) + sum(map(len, ids)) + _AROUND * len(ids)

    def settle(self) -> None:
        if self.size > REMEMBERED_BYTES:
            self.old = dict(self)
            self.clear()
            self.size = 0


class IdEncoder:
    """``encode(texts)``: the ids of each text as bytes, ``end_id`` last."""

    @classmethod
    def of_worker(cls, path: str, end_id: int) -> "IdEncoder":
        """The encoder a Python worker keeps from task to task.

        Code comes anew with every task; the tokenizers library itself is what stays in the worker.
        """
        import tokenizers

        kept = vars(tokenizers).setdefault("_kept_encoders", {})
        if (path, end_id) not in kept:
            kept[path, end_id] = cls(path, end_id)
        return kept[path, end_id]

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.end = np.array([end_id], "<u4").tobytes()
        # Without a normalizer, white space is kept: one space goes with the word after it, a line end stands alone.
        self.keeps_space = self.tokenizer.normalizer is None
        self.first = _Known()
        # White space but the space and the line end; NUL is put between the pieces of a text.
        self.odd = re.compile("[\0\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
                              if self.keeps_space else r"[\x1c-\x1f]")
        self.between, self.mark = self._mark()

    def _mark(self) -> tuple[str, int | None]:
        """What is set between pieces, and its id; none if the tokenizer gives no single one."""
        for between in ("\n",) if self.keeps_space else (" \u20ac ", " \u00a7 ", " = "):
            alone = np.frombuffer(self._whole([between])[0], "<u4")
            if len(alone) == 1:
                return between, int(alone[0])
        return "", None

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces without white space (but one space before), none of them empty."""
        if self.mark is None:
            return self._whole(pieces)
        out: list[bytes] = []
        parts = [pieces[k:k + _JOINED] for k in range(0, len(pieces), _JOINED)]
        for part, raw in zip(parts, self._whole([self.between.join(part) for part in parts])):
            at = np.flatnonzero(np.frombuffer(raw, "<u4") == self.mark)
            if len(at) != len(part) - 1:  # a piece holds the mark itself
                out += self._whole(part)
                continue
            ends = (at * 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(raw)])]
        return out

    def _is_odd(self, text: str) -> bool:
        if self.keeps_space and ("  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[-1:].isspace()):
            return True
        return self.odd.search(text) is not None

    def _cut(self, text: str) -> list[str]:
        if not self.keeps_space:
            return text.split()
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _learn(self, new: list[str]) -> None:
        spaces = [p for p in new if p in ("", "\n")]
        self.first.add(spaces, self._whole(spaces))
        rest = [p for p in new if p not in ("", "\n")] if spaces else new
        for k in range(0, len(rest), 50 * _JOINED):
            part = rest[k:k + 50 * _JOINED]
            self.first.add(part, self._joined(part))

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [k for k, t in enumerate(texts) if self._is_odd(t)]
        whole = dict(zip(odd, self._whole([texts[k] for k in odd])))
        cut = [[] if k in whole else self._cut(t) for k, t in enumerate(texts)]
        self._learn(self.first.missing(set().union(*cut)))
        ids = self.first.__getitem__
        out = [whole[k] + self.end if k in whole else b"".join(map(ids, parts)) + self.end for k, parts in enumerate(cut)]
        self.first.settle()
        return out
