"""Byte-pair encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

A word is spelled with 512 symbols: a byte inside the word, or the byte that ends it. One automaton pass finds the longest token that
starts at each place. Tokens are laid left to right; a token may follow another only if merging the two spellings together gives just
these two (the pair-compatibility test, memoised). Where no token fits, the last one is shortened, and places that
turned out to be dead ends are marked, so every place is left at most once: linear time with the merges' exact result.

Blocks of texts are cut into words and hashed as arrays; a word is encoded when a worker first meets its hash (64 bits, with the length) and
is then looked up among at most ``MEMO_WORDS`` known ones. Texts with letters beyond Latin-1, apostrophes or added tokens take the same
steps one text at a time. The vocabulary is of fixed size and is broadcast.

Defined cases: null text is empty; empty text has no ids, and decodes to the empty string; added tokens are found in the raw text first;
rows are encoded one by one, so repeated rows and null keys give rows of their own; other columns are not read.
"""
from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.blocks import BASE, SPACES, Block, blocks, byte_flags, per_text, span_hashes

MEMO_WORDS = 2_000_000
MEMO_FITS = 500_000
WORD_END = "</w>"

# Letters and digits that Unicode 17 has added. The vocabulary's own library cuts by Unicode 16, where they are neither.
NEW_LETTERS = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f"
    "\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011de0-\\U00011de9"
    "\\U00011df1\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff6"
    "\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128"
    "\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de"
    "\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e"
    "\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f")


def printable_bytes() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones as they are, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def offset_table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All entries in one byte array, and where each begins."""
    return np.frombuffer(b"".join(entries), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in entries])]).astype(np.int64)


def load_tables(path: str) -> dict:
    """Everything the encoder needs, as plain data: spellings, merges, tests, offset tables."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, merges = file["model"]["vocab"], file["model"]["merges"]
    at = printable_bytes()

    def spelled(token: str) -> str:
        body = token.removesuffix(WORD_END)
        text = "".join(chr(at[c]) for c in body)
        return text if body == token else text[:-1] + chr(ord(text[-1]) + 256)

    base = {spelled(t): i for t, i in vocab.items() if len(t.removesuffix(WORD_END)) == 1}
    parts = {i: (i, i) for i in base.values()}
    pairs = {}
    rank = {i: n for n, i in enumerate(sorted(base.values()))}
    for a, b in merges:
        new = vocab[a + b]
        parts[new], pairs[vocab[a], vocab[b]] = (vocab[a], vocab[b]), new
        rank[new] = len(rank)
    spelling = {i: spelled(t) for t, i in vocab.items() if i in rank}
    added = {x["content"]: x["id"] for x in file["added_tokens"]}
    names = {i: t for t, i in (vocab | added).items()}
    if max(names) >= 1 << 16:
        raise ValueError(f"{path}: ids are kept as 16-bit numbers; this vocabulary goes up to {max(names)}")
    listed = [names.get(i, "") for i in range(max(names) + 1)]
    out = {"base": base, "parts": parts, "pairs": pairs, "rank": rank, "added": added, "fits": {},
           "tokens": offset_table([t.encode() + b" " for t in listed]), "decimals": offset_table([b"%d " % i for i in range(len(listed))])}
    # A token that its own merges don't rebuild is never produced, so it must not be matched.
    out["spelling"] = {i: s for i, s in spelling.items() if merged(s, out) == [i]}
    return out


def merged(word: str, tables: dict) -> list[int]:
    """Plain pair merging, lowest rank first; used on vocabulary entries when the tables are made, and in tests."""
    ids = [tables["base"][c] for c in word]
    pairs, rank = tables["pairs"], tables["rank"]
    while len(ids) > 1:
        new = min((pairs[p] for p in zip(ids, ids[1:]) if p in pairs), key=rank.__getitem__, default=None)
        if new is None:
            break
        out, i = [], 0
        while i < len(ids):
            if i + 1 < len(ids) and pairs.get((ids[i], ids[i + 1])) == new:
                out.append(new)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def compatible(left: int, right: int, tables: dict) -> bool:
    """Whether merging the joined spellings of both tokens gives just these two tokens.

    Both are taken apart along the seam, latest merge first. If two parts at the seam would have merged before the merge that was
    taken apart last, the tokens could not have come about side by side.
    """
    pairs, parts, rank = tables["pairs"], tables["parts"], tables["rank"]
    limit = len(rank)
    while True:
        new = pairs.get((left, right))
        if new is not None and rank[new] < limit:
            return False
        a, b = parts[left], parts[right]
        whole_left, whole_right = a[0] == left, b[0] == right
        if whole_left and whole_right:
            return True
        # In a tie of merges the left one happens first: undoing the right token forbids seams up to its own rank.
        if not whole_left and (whole_right or rank[left] > rank[right]):
            limit, left = rank[left], a[1]
        else:
            limit, right = rank[right] + 1, b[0]


def prepared(tables: dict) -> dict:
    """Adds what is quicker to make than to ship: the automaton and each token's longest shorter prefix."""
    if "automaton" not in tables:
        automaton = ahocorasick.Automaton()
        for i, s in tables["spelling"].items():
            automaton.add_word(s, i)
        automaton.make_automaton()
        known = {s: i for i, s in tables["spelling"].items()}
        tables["shorter"] = {i: next((known[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in known), -1) for i, s in tables["spelling"].items()}
        tables["length"] = {i: len(s) for i, s in tables["spelling"].items()}
        tables["automaton"] = automaton
        tables["pattern"] = regex.compile(
            rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{NEW_LETTERS}]]+|[\p{{N}}--[{NEW_LETTERS}]]|(?:[^\s\p{{L}}\p{{N}}]|[{NEW_LETTERS}])+")
        tables["split"] = re.compile("(" + "|".join(map(re.escape, sorted(tables["added"], key=len, reverse=True))) + ")")
    return tables


def encode_word(raw: bytes, tables: dict) -> list[int]:
    """Token ids of one word, by backtracking."""
    text = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
    length, shorter, fits = tables["length"], tables["shorter"], tables["fits"]
    size = len(text)
    longest = [0] * size
    for end, token in tables["automaton"].iter(text):  # later ends overwrite: the longest stays
        longest[end + 1 - length[token]] = token
    token = longest[0]
    if length[token] == size:
        return [token]
    if len(fits) > MEMO_FITS:
        fits.clear()
    dead, out, at, last = set(), [], 0, -1
    while True:
        while True:
            end = at + length[token]
            if end not in dead:
                if last < 0:
                    good = True
                else:
                    good = fits.get(last << 16 | token)
                    if good is None:
                        good = fits[last << 16 | token] = compatible(last, token, tables)
                if good:
                    out.append(token)
                    if end == size:
                        return out
                    at, last, token = end, token, longest[end]
                    break
            token = shorter[token]
            if token < 0:  # nothing fits here: never come back to this place, shorten the token before it
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1


def words_of(text: str, tables: dict) -> list[str]:
    """Normalised pre-tokens of a text that holds no added token."""
    text = unicodedata.normalize("NFC", text)
    # Lower case is taken letter by letter, so a final capital sigma has no form of its own.
    return tables["pattern"].findall(text.replace("Σ", "σ").lower())


def encode(text: str, tables: dict) -> np.ndarray:
    """Ids of one text, of any characters."""
    out: list[int] = []
    for k, part in enumerate(tables["split"].split(text) if "<|" in text else [text]):
        if k % 2:
            out.append(tables["added"][part])
        else:
            for word in words_of(part, tables):
                out += encode_word(word.encode(), tables)
    return np.array(out, np.uint16)


SPACE, LETTER, DIGIT, OTHER = range(4)


def byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[list(SPACES)] = SPACE
    table[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = LETTER
    table[48:58] = DIGIT
    return table


def lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with ASCII and Latin-1 letters in lower case, and where a byte needs the way for all characters: an apostrophe, the start of
    an added token, a control byte, or anything in UTF-8 but the letters from U+00C0 to U+00FF."""
    low = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    odd = (data == 39) | (data < 32) & ~byte_flags(SPACES)[data] | (data == 127)
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    high = data >= 128
    if high.any():
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[lead + 1 < len(data)] + 1
        tail = data[lead]
        letters = lead[(tail != 0x97) & (tail != 0xB7)]
        high[letters] = high[letters - 1] = False
        odd |= high
        capitals = lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)]
        low[capitals] += 32
    return low, odd


class Words:
    """The words a worker has met: sorted hashes, and their ids in one array."""

    def __init__(self):
        self.hashes, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    def find(self, hashes: np.ndarray, words, tables: dict) -> np.ndarray:
        """Positions of sorted distinct hashes; ``words(i)`` gives the bytes of one that is new."""
        if len(self.hashes) > MEMO_WORDS:
            self.__init__()
        at = np.searchsorted(self.hashes, hashes)
        fresh = np.ones(len(hashes), bool)
        inside = at < len(self.hashes)
        fresh[inside] = self.hashes[at[inside]] != hashes[inside]
        new = np.flatnonzero(fresh)
        if not len(new):
            return at
        found = [encode_word(words(i), tables) for i in new]
        sizes = np.array([len(x) for x in found])
        ids = np.concatenate(found)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint16)])
        self.pool[self.used:self.used + len(ids)] = ids
        begin = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        place = at[new]
        self.hashes, self.begin = np.insert(self.hashes, place, hashes[new]), np.insert(self.begin, place, begin)
        self.count = np.insert(self.count, place, sizes)
        return at + np.cumsum(fresh) - fresh


def encode_block(block: Block, tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block one after the other, and where each text's ids begin."""
    memo = tables.setdefault("words", Words())
    low, odd = lowered(block.data)
    strange = per_text(odd, block.offsets) > 0
    if strange.any():
        low = np.where(np.repeat(strange, np.diff(block.offsets)), np.uint8(32), low)
    kind = byte_classes()[low]
    cut = np.ones(len(low), bool)
    if len(low):
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        edges = block.offsets[:-1]
        cut[edges[edges < len(low)]] = True
    bounds = np.append(np.flatnonzero(cut), len(low))
    solid = np.flatnonzero(kind[bounds[:-1]] != SPACE)
    starts, ends = bounds[solid], bounds[solid + 1]
    first = np.searchsorted(starts, block.offsets)
    ids, offsets = np.zeros(0, np.uint16), np.zeros(len(block) + 1, np.int64)
    if len(starts):
        hashes = span_hashes(low, starts, ends)
        with np.errstate(over="ignore"):
            hashes = hashes + (ends - starts).astype(np.uint64) * np.uint64(BASE)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = memo.find(distinct, lambda i: low[starts[where[i]]:ends[where[i]]].tobytes(), tables)[back]
        size = memo.count[at]
        end = np.cumsum(size)
        ids = memo.pool[np.repeat(memo.begin[at] - (end - size), size) + np.arange(end[-1])]
        offsets = np.concatenate([[0], end])[first]
    if strange.any():
        parts = [encode(block.text(i).decode("utf-8", "replace"), tables) if strange[i] else ids[offsets[i]:offsets[i + 1]] for i in range(len(block))]
        ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return ids, offsets


def looked_up(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The table's entries of all ids, one after the other, without the last separator."""
    data, starts = table
    if not len(ids):
        return b""
    begin, size = starts[ids], starts[ids.astype(np.int64) + 1] - starts[ids]
    end = np.cumsum(size)
    return data[np.repeat(begin - (end - size), size) + np.arange(end[-1])].tobytes()[:-1]


def decode(ids: np.ndarray, tables: dict) -> bytes:
    """UTF-8 of the decoded text: the tokens as the vocabulary writes them, with a blank between."""
    return looked_up(ids, tables["tokens"])


def shared_tables(spark, path: str):
    """The tables as a broadcast; their size is that of the vocabulary."""
    return spark.sparkContext.broadcast(load_tables(path))


def encoded(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ids as an array."""
    tables, kind = shared_tables(df.sparkSession, path), df.schema[key].dataType.simpleString()

    def work(batches):
        known = prepared(tables.value)
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids, offsets = encode_block(block, known)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first_row, len(block)), lists], ["doc_id", "ids"])
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, f"doc_id {kind}, ids array<int>")


def decoded(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: key, text of its ids."""
    tables, kind = shared_tables(df.sparkSession, path), df.schema[key].dataType.simpleString()

    def work(batches):
        for batch in batches:
            texts = [decode(np.asarray(x or [], np.int64), tables.value).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return df.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(work, f"doc_id {kind}, text string")


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of ids, SHA-256 of the ids in decimals, SHA-256 of the text that they decode to."""
    tables, kind = shared_tables(df.sparkSession, path), df.schema[key].dataType.simpleString()

    def work(batches):
        known = prepared(tables.value)
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids, offsets = encode_block(block, known)
                each = [ids[offsets[i]:offsets[i + 1]] for i in range(len(block))]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(block.first_row, len(block)), pa.array(np.diff(offsets), pa.int64()),
                    pa.array([hashlib.sha256(looked_up(x, known["decimals"])).hexdigest() for x in each], pa.string()),
                    pa.array([hashlib.sha256(decode(x, known)).hexdigest() for x in each], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        work, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
