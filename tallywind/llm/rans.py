"""Token-id files coded by a static range asymmetric numeral system (operator 8).

A file holds documents in ascending doc_id order. One frequency table, counted over all ids of the file, is
shared by its blocks; each block is coded on its own over interleaved lanes (Duda 2013; Giesen 2014), carries a
CRC-32 of its ids, and keeps checkpoints (lane states and stream position) from which a reader can start, so that
blocks and parts of blocks decode in parallel. Layout: "TWR1", header length, a JSON header, then the sections
that the header names: symbols and frequencies, documents and their lengths, lane states, code words.

Documents are range-partitioned by (doc_id, hash of text), so equal ids spread too; each task writes files of a
bounded number of ids. A manifest row per file gives the ids before it; readers take one file each.

Defined results: a null text is empty, leaving the end id; null doc_ids come first; repeated rows stay, in the
order of their texts' hashes; an empty table gives no file and no rows; other columns aren't read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.llm.common import new_folder, read_file, read_range, save, spread, write_file

BITS, LOW, LANES, STEPS, EVERY = 18, np.uint64(1 << 31), 2048, 256, 128
FILE_IDS = 1 << 22
WORD = np.uint64(32)
DENSE = 1 << 22  # ids below this are looked up in arrays


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols ascending, frequencies of at least 1 that sum to 2**BITS)."""
    counts = np.bincount(ids) if ids.max() < DENSE else None
    symbols, counts = np.unique(ids, return_counts=True) if counts is None else (np.flatnonzero(counts), counts[counts > 0])
    if len(symbols) > 1 << BITS:
        raise ValueError(f"{len(symbols)} different ids in a file; {1 << BITS} at most")
    freq = np.maximum(1, counts * (1 << BITS) // counts.sum())
    over = int(freq.sum()) - (1 << BITS)
    freq[np.argmax(freq)] -= min(over, 0)
    for i in np.argsort(-freq, kind="stable") if over > 0 else ():  # the most frequent give what the rare ones were raised by
        give = min(over, int(freq[i]) // 2)
        freq[i] -= give
        over -= give
        if not over:
            break
    else:
        if over > 0:
            freq = np.maximum(1, np.full(len(freq), (1 << BITS) // len(freq)))
            freq[0] += (1 << BITS) - int(freq.sum())
    return symbols.astype("<u4"), freq.astype("<u4")


def encode_block(index: np.ndarray, freq: np.ndarray, cum: np.ndarray, lanes: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(word positions of the checkpoints, their lane states, code words) for symbol indexes."""
    n, x, out, marks, states, bits = len(index), np.full(lanes, LOW), [], [], [], np.uint64(BITS)
    steps, written = -(-n // lanes), 0
    for t in reversed(range(steps)):
        s = index[t * lanes : (t + 1) * lanes]
        f, v = freq[s], x[: len(s)]
        full = v >= f << np.uint64(31 - BITS + 32)
        out.append((v[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        written += len(out[-1])
        v = np.where(full, v >> WORD, v)
        q = v // f
        x[: len(s)] = (q << bits) + (v - q * f) + cum[s]
        if t % EVERY == 0:
            marks.append(written)
            states.append(x.copy())
    return [written - m for m in reversed(marks)], np.array(states[::-1], "<u8"), np.concatenate(out[::-1])


def decode_part(words: np.ndarray, at: int, state: np.ndarray, n: int, freq: np.ndarray, cum: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """n symbol indexes from a checkpoint's word position and lane states."""
    x, out, lanes, mask, bits = state.astype(np.uint64), np.empty(n, slots.dtype), len(state), np.uint64((1 << BITS) - 1), np.uint64(BITS)
    for start in range(0, n, lanes):
        k = min(lanes, n - start)
        v = x[:k]
        slot = v & mask
        s = slots[slot.astype(np.int64)]
        out[start : start + k] = s
        v = freq[s] * (v >> bits) + slot - cum[s]
        low = np.flatnonzero(v < LOW)
        v[low] = (v[low] << WORD) | words[at : at + len(low)]
        at += len(low)
        x[:k] = v
    return out


def write_ids(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file of the documents' ids, given one after another."""
    symbols, freq = frequency_table(ids)
    f64 = freq.astype(np.uint64)
    if symbols[-1] < DENSE:
        number = np.zeros(int(symbols[-1]) + 1, np.int32)
        number[symbols] = np.arange(len(symbols))
        index = number[ids]
    else:
        index = np.searchsorted(symbols, ids)
    cum = np.cumsum(f64) - f64
    lanes = max(1, min(LANES, len(ids) // 64))
    blocks, states, words, first = [], [], [], 0
    for at in range(0, len(ids), lanes * STEPS):
        part = index[at : at + lanes * STEPS]
        marks, state, code = encode_block(part, f64, cum, lanes)
        blocks.append({"n": len(part), "first_word": first, "words": len(code), "crc32": zlib.crc32(ids[at : at + len(part)].astype("<u4").tobytes()), "marks": marks, "first_state": sum(map(len, states))})
        first += len(code)
        states.append(state)
        words.append(code)
    known = np.array([d is not None for d in doc_ids], "u1")
    sections = {"symbols": symbols, "freq": freq, "known": known, "doc_ids": np.array([d or 0 for d in doc_ids], "<i8"), "lengths": np.array(lengths, "<i8"), "states": np.concatenate(states), "words": np.concatenate(words)}
    packed = {k: v.tobytes() if k in ("states", "words") else zlib.compress(v.tobytes(), 6) for k, v in sections.items()}
    head = json.dumps({"bits": BITS, "lanes": lanes, "every": EVERY, "n": len(ids), "blocks": blocks, "sections": [[k, v.dtype.str, len(packed[k])] for k, v in sections.items()]}).encode()
    return b"TWR1" + len(head).to_bytes(4, "little") + head + b"".join(packed.values())


def _head(data: bytes) -> tuple[dict, dict[str, tuple[str, int, int]]]:
    """(the JSON header, each section's kind, first byte and bytes) from a file's start."""
    if data[:4] != b"TWR1":
        raise ValueError("not a token-id file")
    at = 8 + int.from_bytes(data[4:8], "little")
    head, places = json.loads(data[8:at]), {}
    if head["bits"] != BITS:
        raise ValueError("another table size")
    for name, kind, size in head["sections"]:
        places[name], at = (kind, at, size), at + size
    return head, places


class _Tables:
    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.cum, self.slots = np.cumsum(self.freq) - self.freq, np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    def block(self, b: dict, words: np.ndarray, states: np.ndarray, per: int, part: int | None = None) -> np.ndarray:
        """The ids of a block, checked against its CRC-32, or of the part of it that starts at a checkpoint."""
        chosen = range(len(b["marks"])) if part is None else [part]
        words = words.astype(np.uint64)
        ids = self.symbols[np.concatenate([decode_part(words, b["marks"][i], states[i], min(per, b["n"] - i * per), self.freq, self.cum, self.slots) for i in chosen])]
        if part is None and zlib.crc32(ids.tobytes()) != b["crc32"]:
            raise ValueError("a block's checksum differs")
        return ids


def read_ids(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, all ids) of a file; raises ValueError where a block's checksum differs."""
    head, places = _head(data)
    s = {k: np.frombuffer(data[at : at + size] if k in ("states", "words") else zlib.decompress(data[at : at + size]), kind) for k, (kind, at, size) in places.items()}
    tables, states, per = _Tables(s["symbols"], s["freq"]), s["states"].reshape(-1, head["lanes"]), head["lanes"] * head["every"]
    ids = [tables.block(b, s["words"][b["first_word"] : b["first_word"] + b["words"]], states[b["first_state"] : b["first_state"] + len(b["marks"])], per) for b in head["blocks"]]
    docs = [int(d) if k else None for d, k in zip(s["doc_ids"], s["known"], strict=True)]
    return docs, s["lengths"], np.concatenate(ids)


def count_blocks(uri: str) -> list[tuple[int, int]]:
    """(ids, checkpoints) of each block of a file, from its header alone."""
    head = json.loads(read_range(uri, 8, int.from_bytes(read_range(uri, 4, 4), "little")))
    return [(b["n"], len(b["marks"])) for b in head["blocks"]]


def read_block(uri: str, block: int, part: int | None = None) -> np.ndarray:
    """The ids of one block, or of the part of it between two checkpoints, by reading that block's bytes and the
    tables alone: readers of one file needn't wait for each other. A whole block is checked against its CRC-32."""
    head, places = _head(read_range(uri, 0, 8 + int.from_bytes(read_range(uri, 4, 4), "little")))
    b, lanes = head["blocks"][block], head["lanes"]

    def section(name: str, skip: int = 0, size: int | None = None) -> np.ndarray:
        kind, at, whole = places[name]
        raw = read_range(uri, at + skip, whole if size is None else size)
        return np.frombuffer(raw if size is not None else zlib.decompress(raw), kind)

    states = section("states", 8 * lanes * b["first_state"], 8 * lanes * len(b["marks"])).reshape(-1, lanes)
    return _Tables(section("symbols"), section("freq")).block(b, section("words", 4 * b["first_word"], 4 * b["words"]), states, lanes * head["every"], part)


def _write(path: str | Callable[[], str], end_id: int, folder: str, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallywind.llm.tokens import encoder

        with encoder(path) as e:
            ids_of, task = e.documents, TaskContext.get().partitionId()
            docs, lengths, parts, held, number = [], [], [], 0, 0

            def flush() -> pa.RecordBatch:
                nonlocal held, number
                name = f"{folder}/{task:06d}-{number:04d}-{uuid.uuid4().hex[:8]}.ids"  # a second attempt writes another file; the manifest names one
                write_file(name, write_ids(docs, lengths, np.concatenate(parts)))
                row = pa.RecordBatch.from_pylist([{"task": task, "number": number, "path": name, "n_ids": held}], pa.schema([("task", pa.int64()), ("number", pa.int64()), ("path", pa.string()), ("n_ids", pa.int64())]))
                held, number = 0, number + 1
                for x in (docs, lengths, parts):
                    x.clear()
                return row

            for b in batches:
                doc_ids = b.column(0).to_pylist()
                for row, ids, sizes in ids_of(b.column(1), end_id):
                    ends = np.cumsum(sizes)
                    at = 0
                    while at < len(sizes):  # a file ends with the first document that fills it
                        until = min(len(sizes), 1 + int(np.searchsorted(ends, file_ids - held + (ends[at - 1] if at else 0))))
                        docs += doc_ids[row + at : row + until]
                        lengths += sizes[at:until].tolist()
                        parts.append(ids[ends[at] - sizes[at] : ends[until - 1]])
                        held += len(parts[-1])
                        at = until
                        if held >= file_ids:
                            yield flush()
            if docs:
                yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, before in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), strict=True):
            docs, lengths, ids = read_ids(read_file(name))
            ends, raw = np.cumsum(lengths), ids.astype("<u4").tobytes()
            starts = ends - lengths
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + before, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_files(docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int = 2, folder: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Write docs(doc_id, text) in ascending doc_id order; the manifest (path, n_ids, before), a row per file."""
    folder = folder or new_folder(docs.sparkSession, "ids")
    text = F.col("text").cast("string").alias("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = save(ordered.mapInArrow(_write(tokenizer, end_id, folder, file_ids), "task long, number long, path string, n_ids long"), "ids-manifest")
    # The ids before a file: those of earlier blocks of tasks, of earlier tasks of its block, and of earlier files of its task.
    block, before = F.floor(F.col("task") / 1024).alias("block"), lambda *by: F.coalesce(F.sum("n_ids").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = manifest.groupBy(block, "task").agg(F.sum("n_ids").alias("n_ids"))
    blocks = tasks.groupBy("block").agg(F.sum("n_ids").alias("n_ids")).select("block", before("block").alias("of_blocks"))
    tasks = tasks.select("block", "task", before("block", "task").alias("of_tasks")).join(blocks, "block").select("task", (F.col("of_blocks") + F.col("of_tasks")).alias("ahead"))
    return manifest.select("path", "n_ids", "task", before("task", "number").alias("own")).join(tasks, "task").select("path", "n_ids", (F.col("ahead") + F.col("own")).alias("before"))


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the manifest's files, from the decoded ids."""
    files = manifest.select("path", "before")
    # A stated number of partitions: rows this small would be put into one task, which would decode every file.
    return files.repartition(spread(files), "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
