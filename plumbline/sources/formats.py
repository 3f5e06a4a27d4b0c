"""Bytes of the file formats, to and from numpy arrays."""

from __future__ import annotations

import gzip
import re
import struct
import zlib

import numpy as np


def plain(data: bytes) -> bytes:
    """Without gzip, if it is gzipped."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


# ---- bxyz: flags for normals, colours and deviations; count; records ----------------------------------------------------
def bxyz_dtype(normals: bool, colors: bool, std_devs: bool) -> np.dtype:
    fields = [("p", "<f4", 3)]
    if normals:
        fields.append(("n", "<f4", 3))
    if colors:
        fields.append(("c", "u1", 3))
    if std_devs:
        fields.append(("s", "<f4"))
    return np.dtype(fields)


BXYZ_HEAD = 7


def bxyz_head(data: bytes) -> tuple[np.dtype, int]:
    return bxyz_dtype(*(bool(b) for b in data[:3])), struct.unpack_from("<I", data, 3)[0]


def bxyz_columns(records: np.ndarray, first: int = 0) -> dict[str, np.ndarray]:
    out = {"idx": np.arange(first, first + len(records), dtype=np.int64)}
    for names, field in (("xyz", "p"), (("nx", "ny", "nz"), "n"), ("rgb", "c")):
        for k, n in enumerate(names):
            out[n] = records[field][:, k].astype(np.int16 if field == "c" else np.float64) if field in (records.dtype.names or ()) else None
    out["std_dev"] = records["s"].astype(np.float64) if "s" in (records.dtype.names or ()) else None
    return out


def read_bxyz(data: bytes) -> dict[str, np.ndarray]:
    dtype, n = bxyz_head(data)
    if len(data) < BXYZ_HEAD + n * dtype.itemsize:
        raise ValueError("bxyz: the file is cut short")
    return bxyz_columns(np.frombuffer(data, dtype, n, BXYZ_HEAD))


def write_bxyz(points: np.ndarray, normals=None, colors=None, std_devs=None) -> bytes:
    dtype = bxyz_dtype(normals is not None, colors is not None, std_devs is not None)
    rec = np.zeros(len(points), dtype)
    rec["p"] = points
    for name, values in (("n", normals), ("c", colors), ("s", std_devs)):
        if values is not None:
            rec[name] = values
    return bytes([normals is not None, colors is not None, std_devs is not None]) + struct.pack("<I", len(points)) + rec.tobytes()


# ---- umesh: box, 16-bit vertices in it, faces ------------------------------------------------------------------------
def read_umesh(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = plain(data)
    low, high = np.frombuffer(data, "<f8", 3), np.frombuffer(data, "<f8", 3, 24)
    n = struct.unpack_from("<H", data, 48)[0]
    v = np.frombuffer(data, "<u2", 3 * n, 50).reshape(-1, 3) / 65535.0 * (high - low) + low
    m = struct.unpack_from("<I", data, 50 + 6 * n)[0]
    return v, np.frombuffer(data, "<u2", 3 * m, 54 + 6 * n).reshape(-1, 3).astype(np.int64)


def write_umesh(vertices: np.ndarray, faces: np.ndarray, compress: bool = False) -> bytes:
    if len(vertices) > 65535:
        raise ValueError("umesh holds at most 65535 vertices")
    low, high = vertices.min(axis=0), vertices.max(axis=0)
    size = np.where(high > low, high - low, 1.0)
    scaled = (vertices - low) * (65535.0 / size)
    q = np.floor(scaled + 0.5).astype("<u2")
    out = low.astype("<f8").tobytes() + high.astype("<f8").tobytes() + struct.pack("<H", len(vertices)) + q.tobytes() + struct.pack("<I", len(faces)) + faces.astype("<u2").tobytes()
    return gzip.compress(out, mtime=0) if compress else out


# ---- stl ------------------------------------------------------------------------------------------------------------
STL_RECORD = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")])


def read_stl(data: bytes) -> np.ndarray:
    """Corners (faces, 3, 3) of a binary or text file."""
    if len(data) >= 84 and len(data) == 84 + 50 * struct.unpack_from("<I", data, 80)[0]:
        return np.frombuffer(data, STL_RECORD, offset=84)["v"].astype(float)
    values = re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", data)
    return np.array([[float(x) for x in v] for v in values]).reshape(-1, 3, 3).astype(np.float32).astype(float)


def write_stl(corners: np.ndarray) -> bytes:
    """Faces without area are left out."""
    n = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    size = np.linalg.norm(n, axis=1)
    ok = size > 0
    rec = np.zeros(int(ok.sum()), STL_RECORD)
    rec["n"], rec["v"] = n[ok] / size[ok, None], corners[ok]
    return bytes(80) + struct.pack("<I", len(rec)) + rec.tobytes()


# ---- ply --------------------------------------------------------------------------------------------------------------
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def read_ply(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and faces; of a polygon the first three corners."""
    end = data.index(b"end_header")
    body = data.index(b"\n", end) + 1
    kind, elements = "ascii", []
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], *w[1:-1]))
    vertices, faces = np.zeros((0, 3)), np.zeros((0, 3), np.int64)
    if kind == "ascii":
        lines = iter(data[body:].split(b"\n"))
        for name, n, props in elements:
            rows = [next(lines).split() for _ in range(n)]
            if name == "vertex":
                at = [[p[0] for p in props].index(c) for c in "xyz"]
                vertices = np.array([[float(r[k]) for k in at] for r in rows]).reshape(-1, 3)
            elif name == "face":
                faces = np.array([[int(x) for x in r[1:4]] for r in rows], np.int64).reshape(-1, 3)
        return vertices, faces
    order, at = "<" if kind == "binary_little_endian" else ">", body
    for name, n, props in elements:
        if all(p[1] != "list" for p in props):
            dtype = np.dtype([(p[0], order + PLY_TYPES[p[1]]) for p in props])
            rec = np.frombuffer(data, dtype, n, at)
            at += n * dtype.itemsize
            if name == "vertex":
                vertices = np.stack([rec[c].astype(float) for c in "xyz"], axis=1)
            continue
        out = []
        for _ in range(n):
            for p in props:
                if p[1] == "list":
                    count, item = np.dtype(order + PLY_TYPES[p[2]]), np.dtype(order + PLY_TYPES[p[3]])
                    k = int(np.frombuffer(data, count, 1, at)[0])
                    values = np.frombuffer(data, item, k, at + count.itemsize)
                    at += count.itemsize + k * item.itemsize
                    if p[0] in ("vertex_indices", "vertex_index"):
                        out.append(values[:3].astype(np.int64))
                else:
                    at += np.dtype(PLY_TYPES[p[1]]).itemsize
        if name == "face":
            faces = np.array(out, np.int64).reshape(-1, 3)
    return vertices, faces


def write_ply(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    head = f"ply\nformat ascii 1.0\nelement vertex {len(vertices)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    rows = ["%r %r %r" % tuple(map(float, v)) for v in vertices] + ["3 %d %d %d" % tuple(f) for f in faces]
    return (head + "\n".join(rows) + "\n").encode()


# ---- lptf3: laser profile frames ----------------------------------------------------------------------------------------
LPTF3_HEAD = struct.Struct("<5sHHBI")
LPTF3_FRAME = struct.Struct("<IIiiII")


class Lptf3:
    """Frames of a scan. take_every n keeps frames whose number n divides, and thins their points to one for each stretch
    of n frame steps in x."""

    def __init__(self, data: bytes):
        magic, version, flags, motion, step = LPTF3_HEAD.unpack_from(data)
        if magic != b"LPTF3":
            raise ValueError("lptf3: wrong magic number")
        if version != 1 or motion != 0:
            raise ValueError(f"lptf3: version {version} or motion type {motion} isn't supported")
        self.data, self.y_step = data, step / 1e6
        coordinate = "<i4" if flags & 1 else "<i2"
        self.has_color = bool(flags & 2)
        self.dtype = np.dtype([("x", coordinate), ("z", coordinate), *([("c", "u1")] if self.has_color else [])])

    def frames(self):
        """(frame number, points as x, z, colour, raw x, x resolution) in file order; frames without points are left out."""
        at = LPTF3_HEAD.size
        while at + LPTF3_FRAME.size <= len(self.data):
            number, n, x_off, z_off, x_res, z_res = LPTF3_FRAME.unpack_from(self.data, at)
            at += LPTF3_FRAME.size
            rec = np.frombuffer(self.data, self.dtype, n, at)
            at += n * self.dtype.itemsize
            if n:
                rec = rec[np.argsort(rec["x"], kind="stable")]
                raw = rec["x"].astype(np.int64)
                yield number, raw * (x_res / 1e6) + x_off / 1e3, rec["z"].astype(float) * (z_res / 1e6) + z_off / 1e3, rec["c"].astype(np.int16) if self.has_color else None, raw, x_res / 1e6

    def rows(self, take_every: int | None = None, every_frame: bool = False):
        """frame, idx, x, y, z, color, taken as column arrays for each frame. every_frame: also those that aren't taken."""
        n = take_every if take_every and take_every > 1 else None
        for number, x, z, color, raw, x_res in self.frames():
            keep = n is None or number % n == 0
            if not keep and not every_frame:
                continue
            taken = np.full(len(x), keep)
            if take_every and keep:
                # points are in ascending x: the first one of each stretch of take_every frame steps stands for it
                stretch = np.floor_divide(raw, max(1, int(take_every * self.y_step / x_res)))
                taken[1:] &= np.diff(stretch) > 0
            out = {"frame": np.full(len(x), number, np.int64), "x": x, "y": np.full(len(x), number * self.y_step), "z": z, "color": color, "taken": taken}
            if not every_frame:
                out = {k: v if v is None else v[taken] for k, v in out.items()}
            out["idx"] = np.arange(len(out["x"]), dtype=np.int64)
            yield out


def write_lptf3(frames: list[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]], y_step_nm: int, x_res_nm: int = 1000, z_res_nm: int = 1000, x_offset_um: int = 0, z_offset_um: int = 0, wide: bool = True) -> bytes:
    """frames: (number, raw x, raw z, colours or None)."""
    color = any(f[3] is not None for f in frames)
    kind = "<i4" if wide else "<i2"
    dtype = np.dtype([("x", kind), ("z", kind), *([("c", "u1")] if color else [])])
    out = [LPTF3_HEAD.pack(b"LPTF3", 1, int(wide) | 2 * int(color), 0, y_step_nm)]
    for number, x, z, c in frames:
        rec = np.zeros(len(x), dtype)
        rec["x"], rec["z"] = x, z
        if color:
            rec["c"] = c
        out += [LPTF3_FRAME.pack(number, len(x), x_offset_um, z_offset_um, x_res_nm, z_res_nm), rec.tobytes()]
    return b"".join(out)


# ---- grey images --------------------------------------------------------------------------------------------------------
def write_pgm(image: np.ndarray) -> bytes:
    """Binary portable grey map, 8 or 16 bits."""
    wide = image.dtype == np.uint16
    return f"P5\n{image.shape[1]} {image.shape[0]}\n{65535 if wide else 255}\n".encode() + image.astype(">u2" if wide else "u1").tobytes()


def read_pgm(data: bytes) -> np.ndarray:
    """Portable bit, grey and pixel maps, binary or as text; of colours the mean. Bits are 255 where they are white."""
    words, at = [], 0
    token = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")
    while len(words) < (3 if words and words[0] in (b"P1", b"P4") else 4):
        found = token.match(data, at)
        if not found:
            raise ValueError("a portable map is cut short")
        words.append(found[1])
        at = found.end()
    kind, width, height = words[0], int(words[1]), int(words[2])
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a portable map")
    colors = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1), axis=1)[:, :width]
        return ((1 - bits) * 255).astype(np.uint8)
    if kind == b"P1":
        bits = np.array([c - 48 for c in re.sub(rb"#[^\n]*", b"", data[at:]) if c in b"01"], np.uint8)
        return ((1 - bits[: width * height]) * 255).reshape(height, width)
    top = int(words[3])
    if kind in (b"P5", b"P6"):
        values = np.frombuffer(data, ">u2" if top > 255 else "u1", width * height * colors, at + 1)
    else:
        values = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: width * height * colors], dtype=np.int64)
    image = values.reshape(height, width, colors)
    return image.mean(axis=2).astype(np.uint16 if top > 255 else np.uint8) if colors > 1 else image[..., 0].astype(np.uint16 if top > 255 else np.uint8)


def write_bmp(image: np.ndarray) -> bytes:
    """8-bit grey bitmap, rows from the bottom up."""
    height, width = image.shape
    line = (width + 3) // 4 * 4
    rows = np.zeros((height, line), np.uint8)
    rows[:, :width] = image[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed bitmaps of 1, 8, 24 or 32 bits as grey; of colours the mean of red, green and blue."""
    if data[:2] != b"BM":
        raise ValueError("not a bitmap")
    start, size, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or depth not in (1, 8, 24, 32):
        raise ValueError(f"bitmaps of {depth} bits with packing {packing} aren't supported")
    line = (width * depth + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)
    rows = rows[::-1] if height > 0 else rows
    if depth >= 24:
        image = rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[..., :3].mean(axis=2)
    else:
        index = rows[:, :width] if depth == 8 else np.unpackbits(rows, axis=1)[:, :width]
        used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, :3].mean(axis=1)
        image = palette[index]
    return image.astype(np.uint8)


def read_grey(data: bytes) -> np.ndarray:
    """A grey image of any of these formats, told by its first bytes."""
    return read_png(data) if data[:4] == b"\x89PNG" else read_bmp(data) if data[:2] == b"BM" else read_pgm(data)


#: Format -> how a grey image is written.
GREY_WRITERS = {"png": lambda image: write_png(image), "pgm": write_pgm, "bmp": write_bmp}


# ---- png and the raster container ---------------------------------------------------------------------------------------
def write_png(image: np.ndarray) -> bytes:
    """8- or 16-bit grey, or 8-bit RGB(A)."""
    wide = image.dtype == np.uint16
    kind = {2: 0, 3: {3: 2, 4: 6}.get(image.shape[-1])}[image.ndim]
    rows = image.astype(">u2" if wide else "u1").reshape(image.shape[0], -1).view(np.uint8).reshape(image.shape[0], -1)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 16 if wide else 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Grey image of 1 to 16 bits a pixel; of colours the mean of red, green and blue."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a png image")
    at, packed, palette = 8, b"", None
    while at < len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        at += 12 + n
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
            if interlaced:
                raise ValueError("interlaced png images aren't supported")
        elif name == b"IDAT":
            packed += chunk
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    stride, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    before = np.zeros(stride, np.int64)
    for i in range(height):
        filt, line = raw[i, 0], raw[i, 1:].astype(np.int64)
        if filt == 2:
            line = (line + before) & 255
        elif filt in (1, 3, 4):
            for k in range(stride):
                left = line[k - step] if k >= step else 0
                up, corner = before[k], before[k - step] if k >= step else 0
                if filt == 1:
                    guess = left
                elif filt == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[k] = (line[k] + guess) & 255
        out[i], before = line, line
    if depth == 16:
        pixels = out.reshape(height, -1).view(">u2").astype(np.uint16).reshape(height, width, channels)
    elif depth == 8:
        pixels = out.reshape(height, width, channels)
    else:
        bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)[:, : width * channels]
        pixels = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8).reshape(height, width, channels)
        if kind == 0:
            pixels = (pixels.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if kind == 3 and palette is not None:
        pixels = palette[pixels[..., 0]]
    if pixels.shape[-1] >= 3:
        return (pixels[..., :3].astype(np.uint32).sum(-1) // 3).astype(pixels.dtype)
    return pixels[..., 0]


def read_raster(data: bytes) -> tuple[float, float, float, np.ndarray, np.ndarray]:
    """(pixel size, lowest and highest z, 16-bit values, whether valid)."""
    px, low, high, n = struct.unpack_from("<dddQ", data)
    values = read_png(data[32 : 32 + n])
    (m,) = struct.unpack_from("<Q", data, 32 + n)
    mask = read_png(data[40 + n : 40 + n + m])
    if values.shape != mask.shape:
        raise ValueError("raster: values and mask differ in size")
    return px, low, high, values.astype(np.uint16), mask > 0


def write_raster(px: float, low: float, high: float, values: np.ndarray, mask: np.ndarray) -> bytes:
    v, m = write_png(values.astype(np.uint16)), write_png(np.where(mask, 255, 0).astype(np.uint8))
    return struct.pack("<dddQ", px, low, high, len(v)) + v + struct.pack("<Q", len(m)) + m


def color_map(values: np.ndarray, stops: np.ndarray, limits: tuple[float, float] | None = None) -> np.ndarray:
    """RGBA image by linear stops (n, 3); values that aren't finite are transparent."""
    ok = np.isfinite(values)
    low, high = limits or ((values[ok].min(), values[ok].max()) if ok.any() else (0.0, 1.0))
    t = np.clip((np.where(ok, values, low) - low) / (high - low if high > low else 1.0), 0, 1) * (len(stops) - 1)
    k = np.minimum(t.astype(int), len(stops) - 2)
    rgb = stops[k] + (stops[k + 1] - stops[k]) * (t - k)[..., None]
    return np.concatenate([np.round(rgb), np.where(ok, 255, 0)[..., None]], axis=-1).astype(np.uint8)
