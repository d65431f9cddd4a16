"""PNG files of 8-bit gray or colour images from and to arrays, and Lanczos resampling."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Signature, channels of each colour type.
SIGNATURE, CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(image: np.ndarray) -> bytes:
    """An uncompressed PNG of height x width (gray) or height x width x 3."""
    if image.dtype != np.uint8 or not (image.ndim == 2 or image.ndim == 3 and image.shape[2] == 3):
        raise ValueError("an 8-bit gray or RGB image is expected")
    height, width = image.shape[:2]
    rows = np.zeros((height, 1 + image[0].size), np.uint8)
    rows[:, 1:] = image.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 0)) + _chunk(b"IEND", b"")


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return (np.cumsum(line.reshape(-1, step), axis=0, dtype=np.int64) & 255).astype(np.uint8).ravel()
    if kind == 2:
        return line + above
    out, up = np.zeros(len(line) + step, np.int64), above.astype(np.int64)
    for i, v in enumerate(line.tolist()):
        left, b = int(out[i]), int(up[i])
        if kind == 3:
            guess = (left + b) // 2
        else:
            corner = int(up[i - step]) if i >= step else 0
            near = left + b - corner
            guess = min((abs(near - left), 0, left), (abs(near - b), 1, b), (abs(near - corner), 2, corner))[2]
        out[i + step] = (v + guess) & 255
    return out[step:].astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Height x width for gray, height x width x 3 for colour; alpha is left out, palettes are looked up."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, head, packed, palette = 8, None, [], None
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("the file ends early")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("8 bits a channel without interlacing are expected")
    width, height, step = head[0], head[1], CHANNELS[head[3]]
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    except zlib.error as e:
        raise ValueError("the pixels cannot be read") from e
    image, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        above = image[y] = _unfilter(int(rows[y, 0]), rows[y, 1:], above, step)
    image = image.reshape(height, width, step)
    if head[3] == 3:
        return palette[image[..., 0]]
    return image[..., 0] if step < 3 else image[..., :3]


def _weights(source: int, target: int, support: float = 3.0) -> np.ndarray:
    """Rows of weights of the Lanczos window, widened where the image shrinks."""
    scale = source / target
    wide = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    x = (np.arange(source)[None, :] + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(x) < support, np.sinc(x) * np.sinc(x / support), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos resampling, across and then down, rounded to 8 bits after each."""
    if image.shape[:2] == (height, width):
        return image
    byte = lambda x: np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)
    across = byte(np.einsum("tx,yx...->yt...", _weights(image.shape[1], width), image.astype(float)))
    return byte(np.einsum("ty,yx...->tx...", _weights(image.shape[0], height), across.astype(float)))


def center_crop(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The central square, resampled."""
    h, w = image.shape[:2]
    side = min(h, w)
    return resize(image[(h - side) // 2 : (h + side) // 2, (w - side) // 2 : (w + side) // 2], width, height)


def center_crop_wide(image: np.ndarray, width: int, height: int) -> np.ndarray | None:
    """The central band of the aspect asked for on a black square of ``width``; None for what is too small."""
    h, w = image.shape[:2]
    band = int(np.round(width * h / w))
    if w < width or band < height:
        return None
    part = resize(image[(h - band) // 2 : (h + band) // 2], width, height)
    canvas = np.zeros((width, width, 3), np.uint8)
    canvas[(width - height) // 2 : (width + height) // 2] = part if part.ndim == 3 else part[..., None]
    return canvas


TRANSFORMS = {"center-crop": center_crop, "center-crop-wide": center_crop_wide}
