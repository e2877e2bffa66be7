"""Token counts: pre-tokens that are one token by proof are counted, the rest are merged by the library."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: The mark that stands for a space, in the vocabulary and inside pre-tokens.
SPACE = "▁"
#: Pre-tokens that a worker remembers before it starts afresh, letters of the longest of them, and texts whose unknown ones it merges in one call.
REMEMBERED, LETTERS, TOGETHER = 300_000, 64, 64


class PieceCounter:
    """Counts a sentencepiece BPE model's tokens.

    A text is cut before each space that follows something else, and around
    each line feed. That is exact because no piece of the vocabulary has a
    space mark after another character, or a line feed: no merge crosses a
    cut. ``__init__`` checks both, and that the model keeps white space and
    puts one mark before a text; otherwise ``counts`` gives whole texts to the
    library.
    """

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(self.library.get_piece_size())
        pieces = [self.library.id_to_piece(i) for i in ids if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i) or self.library.is_byte(i))]
        self.cuts = self._keeps_space() and not any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces)
        self.whole = {True: {}, False: {}}
        if self.cuts:
            for marked in self.whole:
                own = [p.removeprefix(SPACE) for p in pieces if p.startswith(SPACE) == marked and p.strip(SPACE)]
                for p, n in zip(own, self._merged(own, marked), strict=True):
                    if n == 1:
                        self.whole[marked][p] = 1
            self.whole[True][""] = self._merged([SPACE], False)[0]  # a mark with nothing after it
        self.known = {marked: dict(whole) for marked, whole in self.whole.items()}

    def _keeps_space(self) -> bool:
        probe = "a  b éﬁ①\nc\td"
        return "".join(self.library.encode(probe, out_type=str)[:4]).startswith(SPACE + "a") and self.library.normalize(probe) == (SPACE + probe).replace(" ", SPACE)

    def _merged(self, parts: list[str], marked: bool) -> list[int]:
        """Tokens of each part by the library, with one space mark before it or with none."""
        if marked:
            return [len(x) for x in self.library.encode(parts, num_threads=1)]
        return [len(x) - 2 for x in self.library.encode(["\n" + p for p in parts], num_threads=1)]

    def _cut(self, text: str) -> tuple[list[str], list[str], int]:
        """Pre-tokens with a space mark before them (left out here), those without, and the number of line feeds."""
        marked: list[str] = []
        bare: list[str] = []
        lines = text.replace(" ", SPACE).split("\n")
        for n, line in enumerate(lines):
            head, *parts = (line if n else SPACE + line).split(SPACE)
            if head:
                bare.append(head)
            if "" in parts:  # runs of marks go with what follows them
                run = ""
                for p in parts[:-1]:
                    if p:
                        marked.append(run + p)
                        run = ""
                    else:
                        run += SPACE
                marked.append(run + parts[-1])
            else:
                marked += parts
        return marked, bare, len(lines) - 1

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        if not self.cuts:
            return [len(x) for x in self.library.encode(texts, num_threads=1)]
        out: list[int] = []
        for at in range(0, len(texts), TOGETHER):
            cut = [self._cut(t) if t else ([], [], 0) for t in texts[at : at + TOGETHER]]
            long: list[list[str]] = []
            for k, marked in enumerate((True, False)):
                known = self.known[marked]
                if len(known) > REMEMBERED:
                    known.clear()
                    known.update(self.whole[marked])
                new = list(set().union(*[c[k] for c in cut]).difference(known))
                known.update(zip(new, self._merged(new, marked), strict=True))
                long.append([p for p in new if len(p) > LETTERS and p not in self.whole[marked]])
            marked, bare = self.known[True].__getitem__, self.known[False].__getitem__
            out += [sum(map(marked, m)) + sum(map(bare, b)) + feeds for m, b, feeds in cut]
            for marks, parts in zip((True, False), long, strict=True):  # so that memory is bounded by letters too
                for p in parts:
                    del self.known[marks][p]
        return out


@lru_cache(maxsize=2)
def counter(model: str) -> PieceCounter:
    return PieceCounter(model)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row: UTF-8 bytes, and the tokens that ``model`` gives the whole text.

    ``model`` is a file that each executor has. Null texts count as empty
    (0 bytes, 0 tokens); repeated rows are counted each; other columns are
    left out. Texts of any length are counted whole, ``TOGETHER`` at a time;
    an empty table stays empty. Nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(model).counts
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = counts(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(key, text).mapInArrow(counted, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def model_path(name: str, folder: str | None = None) -> str:
    """Where the vocabulary file ``name`` lies: in ``folder``, else where the installed package says."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
