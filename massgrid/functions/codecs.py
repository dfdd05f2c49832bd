"""Compact encodings of sequences and id sets; only needed to exchange data, so plain functions."""

from __future__ import annotations

from base64 import b32encode

from massgrid.functions.chemistry import MASS, code_letter, code_number

PEPTIDE_PREFIX, PROTEIN_PREFIX = 6, 16
#: Residues as digits to the base of 32, and numbers over 25 as base32 writes them.
CODED = frozenset(MASS) | {c.lower() for c in MASS}
DIGITS = {ord(c): "0123456789abcdefghijklmnopqrstuv"[code_number(c)] for c in CODED}
OVER = {ord(str(k - 24)): code_letter(k) for k in range(26, 32)}


def compact_size(n: int, prefix: int = PEPTIDE_PREFIX) -> int:
    """Bytes of n residues of 5 bits and a length prefix."""
    return (prefix + 5 * n + 7) // 8


def encode_sequence(sequence: str, prefix: int = PEPTIDE_PREFIX) -> bytes:
    """Length, then 5 bits a residue, most significant bit first, zero-padded."""
    if not 1 <= len(sequence) < 1 << prefix:
        raise ValueError(f"{len(sequence)} residues do not fit a prefix of {prefix} bits")
    if not CODED.issuperset(sequence):
        raise ValueError(f"no residue {next(c for c in sequence if c not in CODED)!r}")
    bits = len(sequence) << 5 * len(sequence) | int(sequence.translate(DIGITS), 32)
    size = compact_size(len(sequence), prefix)
    return (bits << (8 * size - prefix - 5 * len(sequence))).to_bytes(size, "big")


def decode_sequence(data: bytes, prefix: int = PEPTIDE_PREFIX) -> str:
    bits, left = int.from_bytes(data, "big"), 8 * len(data) - prefix
    n = bits >> left
    if 5 * n > left:
        raise ValueError("truncated sequence")
    groups = -(-n // 8)  # base32 takes eight residues at a time
    whole = (bits >> (left - 5 * n) & ((1 << 5 * n) - 1)) << 40 * groups - 5 * n
    return b32encode(whole.to_bytes(5 * groups, "big")).decode()[:n].translate(OVER)


def zigzag(x: int) -> int:
    return -2 * x - 1 if x < 0 else 2 * x


def unzigzag(x: int) -> int:
    return -(x + 1) // 2 if x & 1 else x // 2


def write_varint(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place behind it)."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("truncated number")
        if shift > 63:
            raise ValueError("number is too long")
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def encode_ids(ids: list[int]) -> bytes:
    """Sorted distinct ids: the first by zigzag, then the gaps."""
    out, last = b"", None
    for x in sorted(set(ids)):
        out += write_varint(zigzag(x) if last is None else x - last)
        last = x
    return out


def decode_ids(data: bytes) -> list[int]:
    out: list[int] = []
    at = 0
    while at < len(data):
        x, at = read_varint(data, at)
        out.append(out[-1] + x if out else unzigzag(x))
    return out


def to_signed(x: int, bits: int = 64) -> int:
    """Order-preserving map of unsigned integers to signed ones."""
    return x - (1 << (bits - 1))


def to_unsigned(x: int, bits: int = 64) -> int:
    return x + (1 << (bits - 1))
