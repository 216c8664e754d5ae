"""Column builders: sequence-number codec, Java-compatible hashes, rendezvous scores, sizes and names.

All are built-in expressions that stay in generated code and never overflow under ANSI arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_BITS, SEQ_BITS = 24, 40
MAX_EPOCH, MAX_SEQ = (1 << EPOCH_BITS) - 1, (1 << SEQ_BITS) - 1
#: Partition directories, header and framing sizes of the binary segment format.
HEADER_BYTES, FRAME_BYTES = 26, 8
HINT_STRIDE = 256
_M32 = 1 << 32


def lsn_valid(epoch: Column, seq: Column) -> Column:
    """Whether an epoch and a sequence number fit the packed form."""
    return (epoch >= 0) & (epoch <= MAX_EPOCH) & (seq >= 0) & (seq <= MAX_SEQ)


def lsn_encode(epoch: Column, seq: Column, strict: bool = False) -> Column:
    """Packed log sequence number, epoch above seq. Out of range: null, or an error when strict."""
    packed = F.shiftleft(epoch.cast("long"), SEQ_BITS).bitwiseOR(seq.cast("long"))
    bad = F.raise_error(F.lit("epoch or seq out of range")).cast("long") if strict else F.lit(None).cast("long")
    return F.when(lsn_valid(epoch, seq), packed).otherwise(bad)


def lsn_epoch(lsn: Column) -> Column:
    return F.shiftrightunsigned(lsn, SEQ_BITS).bitwiseAND(F.lit(MAX_EPOCH).cast("long"))


def lsn_seq(lsn: Column) -> Column:
    return lsn.bitwiseAND(F.lit(MAX_SEQ))


def _signed32(x: Column) -> Column:
    return F.when(x >= 1 << 31, x - _M32).otherwise(x)


def bytes_hash(b: Column) -> Column:
    """java.util.Arrays.hashCode of a byte array as bigint: 31-polynomial over signed bytes from 1, wrapping at 32 bits.

    Null gives 0 and the empty array 1.
    """
    # one character a byte; 256 less for a negative byte changes nothing modulo 2**32 but for the sign of the remainder
    chars = F.split(F.decode(b, "ISO-8859-1"), "")
    signed = lambda c: F.ascii(c).cast("long").bitwiseXOR(F.lit(128)) - 128
    fold = F.aggregate(chars, F.lit(1).cast("long"), lambda acc, c: F.pmod(acc * 31 + signed(c), F.lit(_M32)))
    return F.when(b.isNull(), F.lit(0).cast("long")).when(F.octet_length(b) == 0, F.lit(1).cast("long")).otherwise(_let(fold, _signed32))


def key_partition(key: Column, partitions: int) -> Column:
    """Partition of a key: floor modulus of its hash; null and empty keys go to partition 0."""
    bare = key.isNull() | (F.octet_length(key) == 0)
    return _let(F.when(bare, F.lit(0).cast("long")).otherwise(F.pmod(bytes_hash(key), F.lit(partitions))), lambda p: p.cast("int"))


def round_robin(rank: Column, partitions: int) -> Column:
    """Partition of the rank-th arrival (from 0)."""
    return F.pmod(rank, F.lit(partitions)).cast("int")


def partition_owner(pid: Column, nodes: int) -> Column:
    return F.pmod(pid, F.lit(nodes)).cast("int")


def message_id(pid: Column, key: Column, payload: Column) -> Column:
    """64-bit message identity: partition in the high half, mixed key and payload hashes in the low."""
    low = F.pmod(bytes_hash(key) * 31 + bytes_hash(payload), F.lit(_M32))
    return F.shiftleft(pid.cast("long"), 32).bitwiseXOR(low)


def _let(x: Column, f) -> Column:
    """f of x with x evaluated once: a lambda's variable, so that nested uses do not multiply the expression."""
    return F.transform(F.array(x), f)[0]


def _mul64(x: Column, c: int) -> Column:
    """x * c modulo 2**64 as a signed bigint, through 32-bit halves and decimals that hold every product."""
    dec = lambda v: v.cast("decimal(20,0)")
    lit = lambda v: F.lit(str(v)).cast("decimal(18,0)" if v < 10**18 else "decimal(20,0)")
    lo, hi = dec(x.bitwiseAND(F.lit(_M32 - 1))), dec(F.shiftrightunsigned(x, 32))
    cl, ch = c & (_M32 - 1), c >> 32
    cross = F.pmod((hi * lit(cl) + lo * lit(ch)).cast("decimal(38,0)"), lit(_M32))
    total = F.pmod(((lo * lit(cl)).cast("decimal(38,0)") + (cross.cast("decimal(20,0)") * lit(_M32)).cast("decimal(38,0)")).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)"))
    return _let(total, lambda t: F.when(t >= F.lit(str(1 << 63)).cast("decimal(20,0)"), t - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(t).cast("long"))


def rendezvous_score(key: Column, node: Column) -> Column:
    """Highest-random-weight score of a node for a key: golden-ratio product, then two xorshift-multiply rounds."""
    fold = lambda h: h.bitwiseXOR(F.shiftrightunsigned(h, 33))
    h = _let(key.cast("long"), lambda k: _mul64(k, 0x9E3779B97F4A7C15)).bitwiseXOR(node.cast("long"))
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = _let(_let(h, fold), _times(c))
    return _let(h, fold)


def _times(c: int):
    def f(x):
        return _mul64(x, c)

    return f


def tie_breaker(config_version: Column, node: Column) -> Column:
    return F.shiftleft((config_version + 1).cast("long"), 16).bitwiseOR(node.cast("long").bitwiseAND(F.lit(0xFFFF).cast("long")))


def record_bytes(payload: Column) -> Column:
    """Framed size of a stored record."""
    return (F.octet_length(payload) + FRAME_BYTES).cast("long")


def next_pow2(v: Column) -> Column:
    """Least power of two that is at least max(2, v); integer arithmetic only."""
    bits = F.length(F.bin(F.greatest(v, F.lit(2)).cast("long") - 1))
    powers = F.array(*[F.lit(1 << k).cast("long") for k in range(63)])
    return F.element_at(powers, bits + 1)


def epoch_dir(epoch: Column) -> Column:
    return F.concat(F.lit("epoch-"), F.lpad(epoch.cast("string"), 10, "0"))


def parse_epoch_dir(name: Column) -> Column:
    """The epoch of a directory name; null for other names and for numbers beyond 64 bits."""
    return F.regexp_extract(name, r"^epoch-(\d+)$", 1).try_cast("long")


def index_path(segment: Column) -> Column:
    return F.concat(F.regexp_replace(segment, r"\.seg$", ""), F.lit(".idx"))


ROLES = ("INGESTION", "PERSISTENCE")


def parse_role(text: Column) -> Column:
    up = F.upper(F.trim(text))
    return F.when(up.isin(*ROLES), up).otherwise(F.lit("INGESTION"))


def reward(previous: Column, latency: Column) -> Column:
    """Exponentially weighted latency after a success."""
    return previous * 0.8 + latency * 0.2


def penalize(previous: Column) -> Column:
    """Latency estimate after a failure: doubled, between 1 ms and 10 s."""
    return F.greatest(F.least(previous * 2, F.lit(1e10)), F.lit(1e6))


def dlq_topic(topic: Column, retries: Column, most: int = 5) -> Column:
    """The topic a message goes to: its dead-letter topic once it has been retried more than `most` times."""
    return F.when(retries > most, F.concat(topic, F.lit(".DLQ"))).otherwise(topic)
