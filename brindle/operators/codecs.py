"""Byte-exact coders for one frame at a time, for use in Arrow tasks where Spark deals out the frames."""

from __future__ import annotations

import bisect
import struct

import numpy as np


def zigzag(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.int64)
    return np.where(x >= 0, 2 * x, -2 * x - 1)


def unzigzag(z: np.ndarray) -> np.ndarray:
    return np.where(z % 2 == 0, z >> 1, -((z + 1) >> 1))


def rice_encode(z: np.ndarray, k: int) -> bytes:
    """Unary quotients and k-bit remainders, padded with zeros to a byte; k = 0 is stored as 4-byte values after a size byte."""
    z = np.asarray(z, np.int64)
    if k == 0:
        return b"\x04" + z.astype(">u4").tobytes()
    q = z >> k
    starts = np.concatenate([[0], np.cumsum(q + 1 + k)])
    bits = np.zeros(int(starts[-1]), np.uint8)
    ends = starts[:-1] + q
    ones = np.ones(len(bits) + 1, np.int64)
    marks = np.zeros(len(bits) + 1, np.int64)
    np.add.at(marks, starts[:-1], ones[: len(z)])
    np.add.at(marks, ends, -ones[: len(z)])
    bits |= (np.cumsum(marks)[:-1] > 0).astype(np.uint8)
    for j in range(k):
        bits[ends + 1 + j] = z >> (k - 1 - j) & 1
    return np.packbits(bits).tobytes()


def rice_decode(data: bytes, k: int, count: int) -> np.ndarray:
    if k == 0:
        return np.frombuffer(data, ">u4", count, 1).astype(np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    zeros, out, at = np.flatnonzero(bits == 0), np.empty(count, np.int64), 0
    weights = 1 << np.arange(k - 1, -1, -1, dtype=np.int64)
    for i in range(count):
        end = int(zeros[np.searchsorted(zeros, at)])
        out[i] = (end - at) << k | int(bits[end + 1 : end + 1 + k] @ weights)
        at = end + 1 + k
    return out


def best_k(z: np.ndarray, most: int = 30) -> int:
    """The parameter of the shortest code, the least of equals."""
    return min(range(1, most + 1), key=lambda k: (int((z >> k).sum()) + len(z) * (1 + k), k))


def partitioned_encode(z: np.ndarray, size: int = 16) -> bytes:
    """A parameter byte and a two-byte length before each partition's code."""
    out = []
    for at in range(0, len(z), size):
        part = z[at : at + size]
        k = best_k(part)
        code = rice_encode(part, k)
        out.append(struct.pack(">BH", k, len(code)) + code)
    return b"".join(out)


def partitioned_decode(data: bytes, count: int, size: int = 16) -> np.ndarray:
    out, at = [], 0
    for left in range(count, 0, -size):
        k, n = struct.unpack_from(">BH", data, at)
        out.append(rice_decode(data[at + 3 : at + 3 + n], k, min(size, left)))
        at += 3 + n
    return np.concatenate(out) if out else np.zeros(0, np.int64)


TOP, HALF, QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30


def arithmetic_encode(data: bytes) -> bytes:
    """Order-0 arithmetic coding with 32-bit bounds behind a table of the bytes' counts; bits that straddle the middle wait."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    used = np.flatnonzero(counts)
    head = struct.pack(">H", len(used)) + b"".join(struct.pack(">BI", int(s), int(counts[s])) for s in used)
    if len(used) < 2:
        return head
    ends = np.cumsum(counts).tolist()
    starts, total = [0, *ends], ends[-1]
    low, high, waiting, bits = 0, TOP, 0, []
    for symbol in data:
        width = high - low + 1
        low, high = low + width * starts[symbol] // total, low + width * ends[symbol] // total - 1
        while True:
            if high < HALF:
                bits.append("0" + "1" * waiting)
                waiting = 0
            elif low >= HALF:
                bits.append("1" + "0" * waiting)
                waiting, low, high = 0, low - HALF, high - HALF
            elif low >= QUARTER and high < 3 * QUARTER:
                waiting, low, high = waiting + 1, low - QUARTER, high - QUARTER
            else:
                break
            low, high = 2 * low, 2 * high + 1
    bits.append("1" + "0" * (waiting + 1) if low >= QUARTER else "0" + "1" * (waiting + 1))
    text = "".join(bits)
    return head + int(text + "0" * (-len(text) % 8), 2).to_bytes((len(text) + 7) // 8, "big")


def arithmetic_decode(code: bytes, count: int) -> bytes:
    distinct = struct.unpack_from(">H", code)[0]
    table = [struct.unpack_from(">BI", code, 2 + 5 * i) for i in range(distinct)]
    if distinct < 2:
        return bytes([table[0][0]]) * count if table else b""
    symbols = [s for s, _ in table]
    ends = np.cumsum([c for _, c in table]).tolist()
    starts, total = [0, *ends], ends[-1]
    body = code[2 + 5 * distinct :]
    bits = bin(int.from_bytes(b"\x01" + body + bytes(8), "big"))[3:]
    low, high, value, at, out = 0, TOP, int(bits[:32], 2), 32, bytearray()
    for _ in range(count):
        width = high - low + 1
        i = bisect.bisect_right(ends, ((value - low + 1) * total - 1) // width)
        low, high = low + width * starts[i] // total, low + width * ends[i] // total - 1
        out.append(symbols[i])
        while True:
            if high < HALF:
                pass
            elif low >= HALF:
                low, high, value = low - HALF, high - HALF, value - HALF
            elif low >= QUARTER and high < 3 * QUARTER:
                low, high, value = low - QUARTER, high - QUARTER, value - QUARTER
            else:
                break
            low, high, value = 2 * low, 2 * high + 1, 2 * value + (bits[at] == "1" if at < len(bits) else 0)
            at += 1
    return bytes(out)


#: Chunks that are coded side by side, a symbol of each at a time, and the longest chunk that is: products of a width and a
#: count, and quotients of such products, are exact in doubles up to there.
LANES, LONGEST = 2048, 1 << 16


def _bit_length(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64).view(np.int64) >> 52) - 1022


def _narrowed(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds after all doublings of arithmetic_encode, and how many these are: first for the leading bits that bounds share,
    then one for each bit by which they straddle the middle."""
    below = (1 << _bit_length(low ^ high) - 1) - 1  # below the first bit that differs
    shift = 31 - _bit_length(~(low & ~high) & below)
    return low << shift & HALF - 1, (high + 1 << shift) - 1 & TOP | HALF, shift


def _by_length(lengths: np.ndarray):
    """Groups of LANES places, longest first, and for each symbol the number of chunks that have it."""
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        yield lanes, len(lanes) - np.searchsorted(lengths[lanes][::-1], np.arange(lengths[lanes[0]]), "right")


def arithmetic_encode_all(chunks: list[bytes]) -> list[bytes]:
    """arithmetic_encode of each chunk, many at a time. A code is the sum of what each symbol adds to the lower bound, at the
    place that its doublings give; where bits straddle the middle, the sum carries."""
    lengths, codes = np.array([len(c) for c in chunks], np.int64), [b""] * len(chunks)
    for i in np.flatnonzero(lengths > LONGEST):
        codes[i] = arithmetic_encode(chunks[i])
    short = np.flatnonzero(lengths <= LONGEST)
    for lanes, active in _by_length(lengths[short]):
        lanes = short[lanes]
        total = lengths[lanes].astype(np.float64)
        data = np.zeros((len(lanes), len(active)), np.uint8)
        for row, i in zip(data, lanes):
            row[: lengths[i]] = np.frombuffer(chunks[i], np.uint8)
        held = np.arange(len(active)) < lengths[lanes][:, None]
        counts = np.bincount((data + 256 * np.arange(len(lanes))[:, None])[held], minlength=256 * len(lanes)).reshape(-1, 256)
        ends = np.cumsum(counts, 1).astype(np.float64)
        starts, ends, data = (ends - counts).ravel(), ends.ravel(), np.ascontiguousarray(data.T)
        words = (9 * len(active) + 128) // 32  # no more than 8 bits a symbol, and what rounding loses
        sums = np.zeros(len(lanes) * words, np.int64)
        table, place = 256 * np.arange(len(lanes)), words * np.arange(len(lanes))
        low, high, shifted = np.zeros(len(lanes), np.int64), np.full(len(lanes), TOP), np.zeros(len(lanes), np.int64)
        for symbols, n in zip(data, active.tolist()):
            of, width, whole, at = table[:n] + symbols[:n], (high[:n] - low[:n] + 1).astype(np.float64), total[:n], shifted[:n]
            more, most = (np.floor(width * x[of] / whole).astype(np.int64) for x in (starts, ends))
            word, added = place[:n] + (at >> 5), more << 31 - (at & 31)  # a bit less, for the sign
            sums[word] += added >> 31
            sums[word + 1] += (added & HALF - 1) << 1
            low[:n], high[:n], shift = _narrowed(low[:n] + more, low[:n] + most - 1)
            at += shift
        carries, sums = (x.reshape(-1, words).astype(">u4") for x in (sums >> 32, sums & TOP))
        for lane, i in enumerate(lanes):
            used = np.flatnonzero(counts[lane])
            head = np.zeros(len(used), [("symbol", "u1"), ("count", ">u4")])
            head["symbol"], head["count"] = used, counts[lane, used]
            codes[i] = struct.pack(">H", len(used)) + head.tobytes()
            if len(used) > 1:
                bits = int(shifted[lane]) + 2
                code = (int.from_bytes(sums[lane].tobytes(), "big") + (int.from_bytes(carries[lane].tobytes(), "big") << 32) >> 32 * words - bits) + 1
                codes[i] += (code << -bits % 8).to_bytes((bits + 7) // 8, "big")
    return codes


def arithmetic_decode_all(codes: list[bytes], lengths: list[int]) -> list[bytes]:
    """arithmetic_decode of each code, many at a time, by the distance of its value from the lower bound."""
    lengths, chunks = np.array(lengths, np.int64), [b""] * len(codes)
    for i in np.flatnonzero(lengths > LONGEST):
        chunks[i] = arithmetic_decode(codes[i], int(lengths[i]))
    short = np.flatnonzero(lengths <= LONGEST)
    for lanes, active in _by_length(lengths[short]):
        lanes = short[lanes]
        total = lengths[lanes].astype(np.float64)
        bodies = [2 + 5 * struct.unpack_from(">H", codes[i])[0] for i in lanes]
        words = max((len(codes[i]) - at for i, at in zip(lanes, bodies)), default=0) // 4 + 4
        counts, ordered, code = np.zeros((len(lanes), 256), np.int64), np.zeros((len(lanes), max(len(active), 1)), np.uint8), np.zeros((len(lanes), 4 * words), np.uint8)
        for lane, (i, at) in enumerate(zip(lanes, bodies)):
            head = np.frombuffer(codes[i], [("symbol", "u1"), ("count", ">u4")], (at - 2) // 5, 2)
            counts[lane, head["symbol"]] = head["count"]
            ordered[lane, : lengths[i]] = np.repeat(head["symbol"], head["count"])
            code[lane, : len(codes[i]) - at] = np.frombuffer(codes[i], np.uint8, offset=at)
        ends = np.cumsum(counts, 1).astype(np.float64)
        starts, ends = (ends - counts).ravel(), ends.ravel()
        code = code.view(">u4").astype(np.uint64)
        code[:, :-1] = code[:, :-1] << np.uint64(32) | code[:, 1:]  # 64 bits from each word on
        table, place, row = 256 * np.arange(len(lanes)), words * np.arange(len(lanes)), ordered.shape[1] * np.arange(len(lanes))
        low, high, above, at = np.zeros(len(lanes), np.int64), np.full(len(lanes), TOP), (code[:, 0] >> np.uint64(32)).astype(np.int64), np.full(len(lanes), 32)
        code, ordered, out = code.ravel(), ordered.ravel(), np.zeros((len(active), len(lanes)), np.uint8)
        for t, n in enumerate(active.tolist()):
            width, whole = (high[:n] - low[:n] + 1).astype(np.float64), total[:n]
            out[t, :n] = symbols = ordered[row[:n] + (((above[:n] + 1) * whole - 1) / width).astype(np.int64)]
            of = table[:n] + symbols
            more, most = (np.floor(width * x[of] / whole).astype(np.int64) for x in (starts, ends))
            low[:n], high[:n], shift = _narrowed(low[:n] + more, low[:n] + most - 1)
            ahead = code[place[:n] + (at[:n] >> 5)] << (at[:n] & 31).astype(np.uint64)
            above[:n] = (above[:n] - more << shift) + (ahead >> np.uint64(32) >> (32 - shift).astype(np.uint64)).astype(np.int64)
            at[:n] += shift
        for i, chunk in zip(lanes, np.ascontiguousarray(out.T)):
            chunks[i] = chunk[: lengths[i]].tobytes()
    return chunks


def levinson(r: np.ndarray, order: int) -> np.ndarray:
    """Predictor coefficients a (x[n] is near sum a[j] x[n - 1 - j]) from autocorrelations, by the textbook recursion."""
    a, error = np.zeros(order), float(r[0])
    for i in range(order):
        if error <= 0:
            break
        k = (r[i + 1] - a[:i] @ r[i:0:-1]) / error
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        error *= 1 - k * k
    return a


def quantized_lpc(x: np.ndarray, order: int, shift: int = 12) -> np.ndarray:
    x = np.asarray(x, float)
    r = np.array([x[: len(x) - j] @ x[j:] for j in range(order + 1)])
    return np.rint(levinson(r, order) * (1 << shift)).astype(np.int64)


def lpc_encode(x: np.ndarray, order: int = 4, shift: int = 12) -> bytes:
    """order, coefficients, warm-up samples, a Rice parameter and the coded residual; short frames are stored raw."""
    x = np.asarray(x, np.int64)
    if len(x) <= order:
        return struct.pack(">BH", 0, len(x)) + x.astype(">i8").tobytes()
    a = quantized_lpc(x, order, shift)
    windows = np.lib.stride_tricks.sliding_window_view(x, order)[:-1, ::-1]
    z = zigzag(x[order:] - (windows @ a >> shift))
    k = best_k(z, 40)
    return struct.pack(">BHB", order, len(x), k) + a.astype(">i4").tobytes() + x[:order].astype(">i8").tobytes() + rice_encode(z, k)


def lpc_decode(data: bytes, shift: int = 12) -> np.ndarray:
    order, n = struct.unpack_from(">BH", data)
    if not order:
        return np.frombuffer(data, ">i8", n, 3).astype(np.int64)
    at = 4 + 4 * order
    a = np.frombuffer(data, ">i4", order, 4).astype(np.int64)
    x = np.frombuffer(data, ">i8", order, at).astype(np.int64).tolist()
    for e in unzigzag(rice_decode(data[at + 8 * order :], data[3], n - order)).tolist():
        x.append(e + (sum(int(c) * x[-1 - j] for j, c in enumerate(a)) >> shift))
    return np.array(x, np.int64)


MAGIC = 0x46524D45


def pack_container(frames: list[bytes]) -> bytes:
    """A magic number, the number of frames, and each frame behind its length."""
    return struct.pack(">II", MAGIC, len(frames)) + b"".join(struct.pack(">I", len(f)) + f for f in frames)


def unpack_container(data: bytes) -> list[bytes]:
    magic, count = struct.unpack_from(">II", data)
    if magic != MAGIC:
        raise ValueError("not a container")
    out, at = [], 8
    for _ in range(count):
        n = struct.unpack_from(">I", data, at)[0]
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out
