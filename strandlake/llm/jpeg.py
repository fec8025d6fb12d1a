"""Media columns: progressive JPEG read into coefficient arrays scan by scan, and from these into RGB tensors."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._text import record_batch, text_bytes


def _zigzag() -> np.ndarray:
    """Place in the 8 x 8 block, row by row, of each coefficient in scan order: along the anti-diagonals, turning at each edge."""
    cells = [(i, j) for i in range(8) for j in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = _zigzag()


def _inverse_transform() -> np.ndarray:
    """64 x 64: coefficients in natural order times this are samples (inverse DCT-II in two dimensions)."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    return np.kron(one, one).astype(np.float32)


IDCT = _inverse_transform()


#: Pixels of the largest foreign image that is read: a header of a few bytes can ask for any size, and a pixel takes some 20 bytes while it is read.
MOST_PIXELS = 1 << 26


@dataclass
class Component:
    number: int
    h: int
    v: int
    quant: int
    #: Blocks across and down: those that hold samples, and those of whole MCUs.
    width: int = 0
    height: int = 0
    full_width: int = 0
    full_height: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Huffman:
    """symbol[length, code]; only: the symbol, if it is the table's only one, with its code's length."""

    symbol: dict[tuple[int, int], int]
    only: tuple[int, int] | None

    @classmethod
    def read(cls, counts: bytes, values: bytes) -> Huffman:
        code, at, found = 0, 0, {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                found[length, code] = values[at]
                code, at = code + 1, at + 1
            code <<= 1
        return cls(found, (values[0], next(iter(found))[0]) if len(values) == 1 else None)


class Bits:
    """Bits of one restart interval, stuffing removed; reading beyond the end raises an error."""

    def __init__(self, data: bytes) -> None:
        self.bit = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bit):
            raise ValueError("the stream ends within a scan")
        out = 0
        for b in self.bit[self.at : self.at + n]:
            out = out * 2 + b
        self.at += n
        return out

    def decode(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code * 2 + self.take(1)
            if (length, code) in table.symbol:
                return table.symbol[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def unstuffed(data: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes without the zero that follows each 255."""
    full = np.flatnonzero(data[:-1] == 255) if len(data) else np.zeros(0, np.int64)
    return np.delete(data, full[data[full + 1] == 0] + 1) if len(full) else data


def stuffed(data: np.ndarray) -> np.ndarray:
    full = np.flatnonzero(data == 255)
    return np.insert(data, full + 1, 0) if len(full) else data


class Progressive:
    """A progressive image (SOF2, 8 bits, Huffman) as it is read: each scan adds to the components' coefficients.

    A stream that ends early, has no end marker, or says that it has more than `most` pixels raises an error.
    """

    def __init__(self, data: bytes, most: int = MOST_PIXELS) -> None:
        self.most, ended = most, False
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], Huffman] = {}
        self.components: list[Component] = []
        self.restart, self.comment = 0, b""
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG stream")
        while at + 2 <= len(data):
            if data[at] != 255:
                raise ValueError("no marker where one is due")
            marker = data[at + 1]
            if marker == 255:
                at += 1
                continue
            if marker == 0xD9:
                ended = True
                break
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            if len(body) != size - 2:
                raise ValueError("the stream ends within a segment")
            at += 2 + size
            if marker == 0xDB:
                self.read_quant(body)
            elif marker == 0xC4:
                self.read_huffman(body)
            elif marker == 0xC2:
                self.read_frame(body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a progressive Huffman image")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                at = self.read_scan(body, data, at)
        if not self.components:
            raise ValueError("no frame")
        if not ended:
            raise ValueError("no end marker")

    def read_quant(self, body: bytes) -> None:
        while body:
            wide, k = body[0] >> 4, body[0] & 15
            n = 128 if wide else 64
            table = np.zeros(64, np.int32)
            table[ZIGZAG] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8)
            self.quant[k], body = table, body[1 + n :]

    def read_huffman(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            self.tables[body[0] >> 4, body[0] & 15] = Huffman.read(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def read_frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or n not in (1, 3) or not self.height or not self.width:
            raise ValueError("only 8-bit images of 1 or 3 components")
        if self.height * self.width > self.most or 3 * n != len(body) - 6 or self.components:
            raise ValueError("the frame is too large, or no single one")
        self.components = [Component(c, s >> 4, s & 15, q) for c, s, q in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])]
        if any(not 1 <= x <= 4 for c in self.components for x in (c.h, c.v)):
            raise ValueError("no such sampling")
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c.width, c.height = -(-self.width * c.h // (8 * self.h)), -(-self.height * c.v // (8 * self.v))
            c.full_width, c.full_height = self.across * c.h, self.down * c.v
            c.coef = np.zeros((c.full_width * c.full_height, 64), np.int32)

    def units(self, chosen: list[Component]) -> list[list[tuple[int, int]]]:
        """Blocks (component of the scan, index) of each MCU of a scan."""
        if len(chosen) == 1:
            c = chosen[0]
            return [[(0, y * c.full_width + x)] for y in range(c.height) for x in range(c.width)]
        return [[(k, (my * c.v + y) * c.full_width + mx * c.h + x) for k, c in enumerate(chosen) for y in range(c.v) for x in range(c.h)] for my in range(self.down) for mx in range(self.across)]

    def read_scan(self, body: bytes, data: bytes, at: int) -> int:
        by_number = {c.number: c for c in self.components}
        n = body[0]
        chosen = [by_number[body[1 + 2 * k]] for k in range(n)]
        ids = [(body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        end, cuts = at, [at]
        while True:  # up to the next marker that is no restart
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                end = len(data)
                break
            if 0xD0 <= data[end + 1] <= 0xD7:
                cuts.append(end + 2)
            elif data[end + 1]:
                break
            end += 2
        cuts.append(end + 2)
        parts = [unstuffed(np.frombuffer(data, np.uint8)[a : b - 2]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if len(parts) == 1 and self.even_scan(chosen, ids, first, last, high, low, parts[0]):
            return end
        units = self.units(chosen)
        step = self.restart or len(units)
        for k, part in enumerate(parts):
            self.read_interval(units[k * step : (k + 1) * step], chosen, ids, first, last, high, low, Bits(part.tobytes()))
        return end

    def even_scan(self, chosen, ids, first: int, last: int, high: int, low: int, data: np.ndarray) -> bool:
        """A scan whose table has one symbol only, so that all blocks take the same number of bits: read at once. False if it isn't one."""
        if first == 0:
            tables = [self.tables.get((0, d)) for d, _ in ids]
            # With differences of size 0 only, all first values are 0.
            if high or not all(t and t.only and t.only[0] == 0 for t in tables):
                return False
            blocks = chosen[0].width * chosen[0].height if len(chosen) == 1 else self.across * self.down * sum(c.h * c.v for c in chosen)
            return 8 * len(data) >= min(t.only[1] for t in tables) * blocks
        table, c = self.tables.get((1, ids[0][1])), chosen[0]
        if not table or not table.only or (c.width, c.height) != (c.full_width, c.full_height):
            return False
        (symbol, length), band, blocks = table.only, last - first + 1, len(c.coef)
        place = ZIGZAG[first : last + 1]
        if high == 0 and 0 < symbol < 16:
            record = length + symbol
            bits = blocks * band * record
            if 8 * len(data) < bits:
                return False
            if record == 8:
                value = data[: blocks * band].astype(np.int32) & ((1 << symbol) - 1)
            else:
                rows = np.unpackbits(data, count=bits).reshape(-1, record)[:, length:]
                value = rows.astype(np.int32) @ (1 << np.arange(symbol)[::-1])
            value = np.where(value >> (symbol - 1), value, value - (1 << symbol) + 1) << low
            c.coef[:, place] = value.reshape(blocks, band)
            return True
        if high and symbol == 0:
            now = c.coef[:, place]
            if not now.all() or 8 * len(data) < blocks * (length + band):
                return False
            bit = np.unpackbits(data, count=blocks * (length + band)).reshape(blocks, length + band)[:, length:]
            c.coef[:, place] = now + np.sign(now) * (bit.astype(np.int32) << low)
            return True
        return False

    def read_interval(self, units, chosen, ids, first: int, last: int, high: int, low: int, bits: Bits) -> None:
        before, run = [0] * len(chosen), 0
        for unit in units:
            for k, block in unit:
                coef = chosen[k].coef[block]
                if first == 0:
                    if high:
                        coef[0] |= bits.take(1) << low
                    else:
                        before[k] += bits.signed(bits.decode(self.tables[0, ids[k][0]]))
                        coef[0] = before[k] << low
                elif high == 0:
                    run = self.first_pass(coef, self.tables[1, ids[k][1]], first, last, low, run, bits)
                else:
                    run = self.refine(coef, self.tables[1, ids[k][1]], first, last, low, run, bits)

    @staticmethod
    def first_pass(coef, table: Huffman, k: int, last: int, low: int, run: int, bits: Bits) -> int:
        """Reads a block of a band for the first time; returns how many further blocks end before they begin."""
        if run:
            return run - 1
        while k <= last:
            zeros, size = divmod(bits.decode(table), 16)
            if size:
                k += zeros
                if k > last:
                    raise ValueError("a run leaves the band")
                coef[ZIGZAG[k]] = bits.signed(size) * (1 << low)
                k += 1
            elif zeros < 15:
                return (1 << zeros) + bits.take(zeros) - 1
            else:
                k += 16
        return 0

    @staticmethod
    def refine(coef, table: Huffman, k: int, last: int, low: int, run: int, bits: Bits) -> int:
        """One more bit for what is not zero yet, and new coefficients of size one."""

        def correct(p: int) -> None:
            if bits.take(1):
                coef[p] += (1 << low) if coef[p] > 0 else -(1 << low)

        while not run and k <= last:
            zeros, size = divmod(bits.decode(table), 16)
            value = 0
            if size:
                value = (1 << low) if bits.take(1) else -(1 << low)
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= last:
                p = ZIGZAG[k]
                k += 1
                if coef[p]:
                    correct(p)
                elif zeros:
                    zeros -= 1
                else:
                    coef[p] = value
                    break
        if run:
            for p in ZIGZAG[k : last + 1]:
                if coef[p]:
                    correct(p)
            return run - 1
        return 0

    def rgb(self) -> np.ndarray:
        """height x width x 3, 8 bits; chroma samples are repeated to full resolution, grey images have three equal planes."""
        planes = []
        for c in self.components:
            block = (c.coef * self.quant[c.quant]).astype(np.float32) @ IDCT + np.float32(128)
            plane = np.clip(block, 0, 255).reshape(c.full_height, c.full_width, 8, 8).swapaxes(1, 2).reshape(8 * c.full_height, 8 * c.full_width)
            if (up := (self.v // c.v, self.h // c.h)) != (1, 1):
                plane = plane.repeat(up[0], 0).repeat(up[1], 1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(np.rint(planes[0]).astype(np.uint8)[:, :, None], 3, 2)
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        # Full-range colour of JFIF (ITU-R BT.601).
        out = np.stack([y + np.float32(1.402) * r, y - np.float32(0.344136) * b - np.float32(0.714136) * r, y + np.float32(1.772) * b], 2)
        return np.rint(np.clip(out, 0, 255)).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


#: Coefficients of each block that hold payload: two bands of the scan order.
BANDS = ((1, 24), (25, 48))
_PER_BLOCK = 48
#: MCUs of 2 x 2 luma blocks and one block of each chroma.
_PER_MCU = 6 * _PER_BLOCK


def store(payload: bytes) -> bytes:
    """A progressive 4:2:0 image whose AC coefficients are the payload: byte b is the coefficient of size 8 whose magnitude bits are b.

    That is b for b > 127 and b - 255 below. The first scans bring the upper seven bits, the second ones the last bit. What
    is missing to whole rows of MCUs is filled with bytes 255; a comment has the payload's length.
    """
    units = -(-len(payload) // _PER_MCU)
    across = 2 * max(1, -(-units // 8000))
    down = max(1, -(-units // across))
    if 16 * max(across, down) > 65535:
        raise ValueError("the payload is too long for one image")
    total = across * down
    data = np.full(total * _PER_MCU, 255, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    y, cb, cr = np.split(data.reshape(-1, _PER_BLOCK), [4 * total, 5 * total])
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # One code, of one bit, in each table: DC differences of size 0; AC of size 7 without zeros before; end of block.
    for number, symbol in ((0x00, 0x00), (0x10, 0x07), (0x11, 0x00)):
        out.append(_segment(0xC4, bytes([number, 1, *[0] * 15, symbol])))
    bits = np.zeros(6 * total, np.uint8)
    out += [_segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0])), padded_bits(bits)]
    for number, part in enumerate((y, cb, cr), 1):
        for first, last in BANDS:
            out += [_segment(0xDA, bytes([1, number, 0x00, first, last, 0x01])), (part[:, first - 1 : last] >> 1).tobytes()]
    for number, part in enumerate((y, cb, cr), 1):
        low = (part ^ np.where(part > 127, 0, 1).astype(np.uint8)) & 1
        for first, last in BANDS:
            rows = np.zeros((len(part), last - first + 2), np.uint8)
            rows[:, 1:] = low[:, first - 1 : last]
            out += [_segment(0xDA, bytes([1, number, 0x01, first, last, 0x10])), padded_bits(rows.ravel())]
    return b"".join(out) + b"\xff\xd9"


def padded_bits(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes, the last one filled with ones."""
    return stuffed(np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)]))).tobytes()


def payload_of(image: Progressive) -> bytes:
    place = ZIGZAG[1 : _PER_BLOCK + 1]
    coef = np.concatenate([c.coef[:, place] for c in image.components]).ravel()
    return np.where(coef > 0, coef, coef + 255).astype(np.uint8).tobytes()[: int(image.comment.split()[1])]


def decode(df: DataFrame, column: str, key: str, most: int = MOST_PIXELS) -> DataFrame:
    """(key, height, width, rgb, error) of each row of a column of progressive JPEG streams; rgb: row by row, 3 bytes a pixel.

    Null, cut, broken and other streams, and those of more than `most` pixels, have null tensors and the reason in error; rows are kept as they are repeated.
    """
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            height, width, rgb, error = [], [], [], []
            for x in b.column("media").to_pylist():
                try:
                    if x is None:
                        raise ValueError("null")
                    made = Progressive(bytes(x), most).rgb()
                    height.append(made.shape[0]), width.append(made.shape[1]), rgb.append(made.tobytes()), error.append(None)
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    height.append(None), width.append(None), rgb.append(None), error.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(height, pa.int32()), pa.array(width, pa.int32()), pa.array(rgb, pa.binary()), pa.array(error, pa.string())], ["key", "height", "width", "rgb", "error"])

    made = df.select(F.col(key).alias("key"), F.col(column).alias("media")).mapInArrow(run, f"key {kind}, height int, width int, rgb binary, error string")
    return made.withColumnRenamed("key", key) if key != "key" else made


UNIT = 576


def store_texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) for each row.

    A text's bytes, filled with 255 to a positive multiple of 576, become an image, which is read back into coefficients and
    a tensor; feature: height x width, mean and deviation of red, green and blue. Null texts are empty; null ids stay null.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def one(text: np.ndarray) -> tuple:
        payload = text.tobytes() + b"\xff" * (UNIT * max(1, -(-len(text) // UNIT)) - len(text))
        media = store(payload)
        image = Progressive(media, 65535 * 65535)
        back = payload_of(image)
        rgb = image.rgb().reshape(-1, 3)
        mean, spread = rgb.mean(0), rgb.std(0)
        feature = f"{image.height}x{image.width}:" + ",".join(f"{m:.3f}" for m in (*mean, *spread))
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches):
        for b in batches:
            data, at = text_bytes(b.column("text"))
            made = [one(data[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            if made:
                yield record_batch(schema, [b.column("doc_id"), *zip(*made, strict=True)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
