"""Language-model scores by online logistic context mixing, with a word-frequency base score beside it.

*Symbols and bits.* A text is its lower-cased words and one end. Frequent training words and the end are
symbols of a Huffman tree; any other word is an escape, then its bytes (all 256) and a word end, which are
symbols of a second tree. So every text is a sequence of bits: the turns taken at the trees' nodes.

*Predictors.* At each node several contexts give a probability: at words the corpus' word frequencies, the
word before and, behind a frequent word, the two words before (hashed), and the text's own last continuation
of its last two words; at bytes the two, three and five bytes before (hashed, within the word), and the
text's own last continuation of the word so far. Corpus contexts count the turns that training texts took
there and back off to the next shorter context, the shortest to the symbols' frequencies; the text's own
ones are updated after each symbol. Where a longer context is no longer than the shorter one, both are one.

*Mixing.* The predictions are added in the logistic domain with weights gated by tree, depth and state of
the text's own match; a map of the text's own refines the sum. Weights and map start from constants and are
learned online from the text itself, segment by segment (the first has four symbols, later ones grow with
the position up to 4096 symbols, however long the text is), so a score depends on nothing but the text and
the counts. The bits add up to the score and to bits per byte.

*Counts at any size.* Nothing that grows with the corpus is broadcast. Texts lie in blocks; a block sends
the distinct (context, symbol) pairs that its texts use, with their training counts, to the ranges of
contexts (packed arrays, shuffled; contexts are hashes of 47 bits), the texts stay where they lie; a range adds up all counts and answers each block with the turns at
the nodes on its pairs' paths, each node once; the block then scores its texts. Word counts take the same way. There are
no samples, prefixes or left-out rows: every training row is counted, every whole text is scored.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.memo import Runs
from graphloom.llm.quality import in_fold
from graphloom.llm.textarrays import LOWER, blocks, bounded_batches, mix, powers, text_bytes, word_bounds, word_hashes
from graphloom.sources.shared_storage import drop_shared, new_path, write_shared

#: Words that are symbols: at most so many, each counted so often at least.
VOCABULARY, LEAST_COUNT = 1 << 16, 2
#: Bytes of text in a block, and symbols that are mixed at once.
BLOCK_BYTES, TILE = 2 << 20, 1 << 15
#: Blocks that are scored as one group.
BUNDLE = 8
#: Weight of the shorter context when a longer one backs off to it.
BACK_OFF = 0.5
#: Bytes before that are contexts of a byte, and the share of all tokens that makes a word frequent.
BYTES_BEFORE, FREQUENT = (2, 3, 5), 1 / 256
#: Symbols of a text's first segment, and of its longest ones.
FIRST_SEGMENT, LONGEST_SEGMENT = 4, 4096
#: Inputs of the mixer, sets of weights, buckets of the refinement map.
INPUTS, DEPTHS, RUNS, BUCKETS = 4, 4, 4, 12
#: Weights before anything is learned: of the shortest corpus context first, of the text's own match last.
FIRST_WEIGHTS = (0.0, 0.2, 0.8, 0.5)
GATES = 2 * DEPTHS * RUNS
#: What a starting weight and a starting map entry count for, in curvature.
WEIGHT_PRIOR, MAP_PRIOR = 8.0, 40.0
#: Log odds of the text's own match after 0, 1, 2 and more matches in a row.
MATCH_ODDS = np.array([0.5, 1.5, 2.5, 4.0], np.float32)
# Odd multipliers and tags that keep kinds of contexts apart.
ODD = np.uint64(0x9E3779B97F4A7C15)
TAGS = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x589965CC75374CC3), np.uint64(0x8EBC6AF09C88C6E3)]
#: Trailing bits of a context of two words that tell the first of them (of these, the last 17 give way to the leaf).
SECOND_BITS = np.uint64(34)
#: Bits of a pair's key that are the symbol's leaf; the others are the hash of its context.
LEAF_BITS = np.uint64(17)
#: Turns at a node are answered as one byte: exact pairs of counts up to EXACT in sum, else their log odds.
EXACT, ODDS_STEP, MANY = 10, 0.25, 60.0


def _turn_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte of each exact pair of counts (on, off), and the counts that each byte stands for."""
    code = np.zeros((EXACT + 1, EXACT + 1), np.uint8)
    on, off = np.zeros(256, np.float32), np.zeros(256, np.float32)
    n = 0
    for total in range(EXACT + 1):
        for i in range(total + 1):
            code[i, total - i], on[n], off[n] = n, i, total - i
            n += 1
    share = 1 / (1 + np.exp(-(np.arange(n, 256) - (n + 255) / 2) * ODDS_STEP))
    on[n:], off[n:] = MANY * share, MANY * (1 - share)
    return code, on, off


TURN_CODE, TURN_ON, TURN_OFF = _turn_tables()
TURN_SUM = TURN_ON + TURN_OFF
FIRST_ODDS = (EXACT + 1) * (EXACT + 2) // 2
#: The byte for the same turns counted the other way round.
OTHER_WAY = np.concatenate([TURN_CODE[TURN_OFF[:FIRST_ODDS].astype(int), TURN_ON[:FIRST_ODDS].astype(int)], np.arange(255, FIRST_ODDS - 1, -1)]).astype(np.uint8)


def turn_codes(on: np.ndarray, off: np.ndarray) -> np.ndarray:
    few = on + off <= EXACT
    out = np.empty(len(on), np.uint8)
    out[few] = TURN_CODE[on[few], off[few]]
    many = ~few
    odds = np.log((on[many] + 0.3) / (off[many] + 0.3)) / ODDS_STEP + (FIRST_ODDS + 255) / 2
    out[many] = np.clip(np.rint(odds), FIRST_ODDS, 255)
    return out


def next_cut(cut: int) -> int:
    """Where the segment ends that begins there: segments are half as long as all before them, within bounds."""
    return cut + min(max(cut // 2, FIRST_SEGMENT), LONGEST_SEGMENT)


@dataclass
class Code:
    """The two code trees. Symbols: words (in the order of ``hashes``), end, escape, 256 bytes, word end."""

    hashes: np.ndarray  # of the words that are symbols, ascending
    counts: np.ndarray  # of these words in training texts
    leaf: np.ndarray  # of each symbol: its place among all leaves
    lengths: np.ndarray  # of each symbol's path
    starts: np.ndarray
    nodes: np.ndarray  # paths of all symbols, one after another
    bits: np.ndarray
    odds: np.ndarray  # log odds of each turn of these paths, by the symbols' frequencies
    share: np.ndarray  # their probabilities
    gates: np.ndarray  # of each turn: the set of weights, but for the text's own match
    word: np.ndarray  # of each symbol: its path as the leading bits of a number
    middle: np.ndarray  # of each node: first leaf of its 1 side
    of_leaf: np.ndarray  # the symbol of each leaf
    tokens: int
    distinct: int
    documents: int

    @property
    def end(self) -> int:
        return len(self.hashes)


def _tree(weights: np.ndarray, first_leaf: int, first_node: int):
    """Huffman tree of these symbols: (leaf, path) per symbol and (middle, log odds) per node."""
    heap = [(float(w), i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    n = len(weights)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], n, (a, b)))
        n += 1
    leaf, paths = np.zeros(len(weights), np.int64), [None] * len(weights)
    middle, odds, placed = [], [], 0
    stack = [(heap[0], ())]
    while stack:
        item, path = stack.pop()
        if item is None:  # the 0 side of a node is done
            middle[path] = first_leaf + placed
        elif isinstance(item[2], tuple):
            node = len(middle)
            middle.append(0)
            zero, one = item[2]
            odds.append(math.log(one[0] / zero[0]))
            stack += [(one, (*path, (first_node + node, 1))), (None, node), (zero, (*path, (first_node + node, 0)))]
        else:
            leaf[item[2]] = first_leaf + placed
            paths[item[2]] = path
            placed += 1
    return leaf, paths, middle, odds


def make_code(hashes: np.ndarray, counts: np.ndarray, byte_counts: np.ndarray, tokens: int, distinct: int, documents: int) -> Code:
    escapes = tokens - documents - int(counts.sum())
    leaf, paths, middle, odds = _tree(np.concatenate([counts, [documents, escapes]]) + 0.5, 0, 0)
    leaf_b, paths_b, middle_b, odds_b = _tree(np.concatenate([byte_counts, [tokens - documents]]) + 0.5, len(leaf), len(middle))
    paths += paths_b
    lengths = np.array([len(p) for p in paths], np.int64)
    flat = [step for p in paths for step in p]
    nodes, bits = np.array([a for a, _ in flat], np.int32), np.array([b for _, b in flat], np.int8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    turn = np.array(odds + odds_b, np.float32)[nodes] * (2 * bits - 1)
    depth = np.arange(len(nodes)) - np.repeat(starts, lengths)
    word = np.add.reduceat(np.where(depth < 64, bits.astype(np.uint64) << np.minimum(63 - depth, 63).clip(0).astype(np.uint64), np.uint64(0)), starts)
    gates = (RUNS * (np.minimum(depth // 3, DEPTHS - 1) + DEPTHS * (nodes >= len(middle)))).astype(np.int8)
    share = 1 / (1 + np.exp(-turn))
    leaf = np.concatenate([leaf, leaf_b])
    return Code(hashes, counts, leaf, lengths, starts, nodes, bits, turn, share, gates, word, np.array(middle + middle_b), np.argsort(leaf).astype(np.int32), tokens, distinct, documents)


# ---- a block's symbols and contexts


def order_of(keys: np.ndarray, bits: int = 64) -> np.ndarray:
    """A stable order of unsigned keys of so many bits: sorts their leading bits packed with their places, which
    is much faster than an indirect sort, and then mends the rare runs that differ in the bits cut off."""
    keys = keys.astype(np.uint64, copy=False)
    n = len(keys)
    if n < 2:
        return np.arange(n)
    b = np.uint64((n - 1).bit_length())
    high = keys << np.uint64(64 - bits) if bits < 64 else keys
    order = ((high >> b) << b) | np.arange(n, dtype=np.uint64)
    order.sort()
    order = (order & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)
    if bits + int(b) > 64:
        ranked = high[order]
        top = ranked >> b
        same = top[1:] == top[:-1]
        odd = np.flatnonzero(same & (ranked[1:] != ranked[:-1]))
        if len(odd):  # whole runs with equal leading bits, in order of all bits
            rows = np.flatnonzero(np.isin(top, top[odd]))
            order[rows] = order[rows][np.argsort(ranked[rows], kind="stable")]
    return order


def _dense(keys: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key occurs first, in ascending order, and every key's number among them."""
    order = order_of(keys, bits)
    if not len(order):
        return order, order
    ranked = keys[order]
    new = np.empty(len(keys), bool)
    new[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _dense_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_dense`` of pairs' keys: sorts as many leading bits of the contexts as have room beside the leaves and the
    places, and then mends the runs in which these bits stand for several contexts."""
    n = len(keys)
    if n < 2:
        return np.arange(n), np.arange(n)
    b, leaf = np.uint64((n - 1).bit_length()), (np.uint64(1) << LEAF_BITS) - np.uint64(1)
    ranked = keys >> (b + LEAF_BITS) << LEAF_BITS
    ranked |= keys & leaf
    ranked <<= b
    ranked |= np.arange(n, dtype=np.uint64)
    ranked.sort()
    order = (ranked & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)
    head = ranked >> (b + LEAF_BITS)
    ranked = keys[order]
    other = ranked[1:] ^ ranked[:-1]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(head[1:], head[:-1], out=new[1:])
    mixed_up = np.flatnonzero((other > leaf) & ~new[1:])
    if len(mixed_up):
        first = np.flatnonzero(new)
        runs = np.unique(np.searchsorted(first, mixed_up, side="right") - 1)
        rows = _paths(first[runs], np.append(first, n)[runs + 1] - first[runs])
        order[rows] = order[rows][np.argsort(ranked[rows], kind="stable")]
        ranked[rows] = keys[order[rows]]
        other = ranked[1:] ^ ranked[:-1]
    np.not_equal(other, 0, out=new[1:])
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


@dataclass
class Stream:
    """Symbols of a block's texts, one after another."""

    symbols: np.ndarray
    bounds: np.ndarray  # of the texts
    at_byte: np.ndarray  # places of the symbols of the byte tree
    contexts: list[np.ndarray]  # hashes, from short to long: the first two of every symbol, the third of those at at_byte
    own: np.ndarray  # hash of the text's own context of every symbol
    n_words: np.ndarray
    words: np.ndarray  # hashes of all words
    known: np.ndarray  # place of each word among the code's, or -1


def stream(code: Code, data: np.ndarray, offsets: np.ndarray) -> Stream:
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    n_words = np.diff(first)
    n, n_texts = len(words), len(n_words)
    at = np.searchsorted(code.hashes, words)
    at[at == len(code.hashes)] = 0
    is_known = code.hashes[at] == words if len(code.hashes) else np.zeros(n, bool)
    rare = np.flatnonzero(~is_known)
    size = np.ones(n, np.int64)
    size[rare] = ends[rare] - starts[rare] + 2
    total = np.concatenate([[0], np.cumsum(size)])
    bounds = total[first] + np.arange(n_texts + 1)
    place = total[:-1] + np.repeat(np.arange(n_texts), n_words)  # of each word's first symbol
    symbols = np.full(int(bounds[-1]), code.end, np.int32)
    symbols[place] = np.where(is_known, at, code.end + 1)
    # Contexts of words: the one or two words before, in the same text.
    before = np.zeros(n + n_texts, np.uint64)
    slot = np.arange(n) + np.repeat(np.arange(n_texts), n_words)
    last = slot + 1  # the word after, or the end
    before[last] = words
    two = np.zeros(n + n_texts, np.uint64)
    not_first = np.ones(n, bool)
    not_first[first[:-1][n_words > 0]] = False
    two[last[not_first]] = words[np.flatnonzero(not_first) - 1]
    behind = np.zeros(n + n_texts, bool)  # a frequent word and another one
    if len(code.hashes):
        behind[last[not_first]] = (is_known & (code.counts[at] >= FREQUENT * code.tokens))[np.flatnonzero(not_first) - 1]
    begin = first[:-1] + np.arange(n_texts)
    before[begin] = two[begin] = behind[begin] = 0
    word_places = np.empty(n + n_texts, np.int64)
    word_places[slot] = place
    word_places[first[1:] + np.arange(n_texts)] = bounds[1:] - 1
    context, own = np.zeros(len(symbols), np.uint64), np.zeros(len(symbols), np.uint64)
    context[word_places] = mix(before + TAGS[0])
    own[word_places] = mix(before * ODD + two)
    # Bytes of the other words.
    letters = ends[rare] - starts[rare]
    each = letters + 1
    upto = np.cumsum(each)
    step = np.arange(int(upto[-1]) if len(upto) else 0) - np.repeat(upto - each, each)
    at_byte = np.repeat(place[rare], each) + 1 + step
    letter = np.zeros(len(step), np.int64)
    inner = step < np.repeat(letters, each)
    letter[inner] = LOWER[data[(np.repeat(starts[rare], each) + step)[inner]]]
    symbols[at_byte] = np.where(inner, letter, 256) + code.end + 2
    back, total = [], np.zeros(len(step), np.uint64)
    for k in range(1, BYTES_BEFORE[-1] + 1):
        prior = np.zeros(len(step), np.uint64)
        prior[k:] = letter[:-k] + 1 if k < len(step) else 0
        prior[step < k] = 0
        total = total + prior * np.uint64(257 ** (k - 1))
        if k in BYTES_BEFORE:
            back.append(mix(total + TAGS[1]))
    own[at_byte] = mix(_so_far(letter, step) + TAGS[2])
    longer = context.copy()
    # The leading bits are those of the word before: keys of one word lie together and so pack well.
    head = mix(before + TAGS[3])[behind] >> SECOND_BITS << SECOND_BITS
    longer[word_places[behind]] = head | mix(two[behind]) >> (np.uint64(64) - SECOND_BITS)
    context[at_byte], longer[at_byte] = back[:2]
    return Stream(symbols, bounds, at_byte, [context, longer, back[2]], own, n_words, words, np.where(is_known, at, -1))


def _so_far(letter: np.ndarray, step: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word before each of its bytes."""
    n = len(letter)
    steps, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((letter.astype(np.uint64) + np.uint64(1)) * steps, out=total[1:])
    begin = np.arange(n) - step
    return (total[:-1] - total[begin]) * inverse[begin]


def _paths(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for all runs of these lengths."""
    some = lengths > 0
    if not some.all():
        starts, lengths = starts[some], lengths[some]
    if not len(lengths):
        return np.zeros(0, np.int64)
    upto = np.cumsum(lengths)
    steps = np.ones(int(upto[-1]), np.int64)
    steps[0] = starts[0]
    steps[upto[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(steps, out=steps)


def shared_turns(code: Code, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many turns the paths of two different symbols of a tree share."""
    differ = code.word[a] ^ code.word[b]
    high, low = (differ >> np.uint64(32)).astype(np.float64), (differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 31 - np.log2(np.maximum(high, 1)).astype(np.int64), 63 - np.log2(np.maximum(low, 1)).astype(np.int64))


@dataclass
class Pairs:
    """Distinct (context, symbol) pairs of a block, as ascending keys: hash of the context, then leaf of the symbol."""

    keys: np.ndarray
    symbols: np.ndarray
    of: np.ndarray  # the pair of every context of a stream, one kind after another
    place: np.ndarray  # where each pair occurs first


def pairs(code: Code, s: Stream) -> Pairs:
    n, (first, second, third) = len(s.symbols), s.contexts
    # A context that is one with the next shorter one has its pair.
    longer = np.flatnonzero(first != second)
    longest = np.flatnonzero(second[s.at_byte] != third)
    at = np.concatenate([np.arange(n), longer, s.at_byte[longest]])
    keys = np.concatenate([first, second[longer], third[longest]]) >> LEAF_BITS << LEAF_BITS
    keys |= code.leaf[s.symbols].astype(np.uint64)[at]
    place, number = _dense_pairs(keys)
    of = np.empty(2 * n + len(s.at_byte), np.int64)
    of[:n] = of[n : 2 * n] = number[:n]
    of[n + longer] = number[n : n + len(longer)]
    of[2 * n :] = of[n + s.at_byte]
    of[2 * n + longest] = number[n + len(longer) :]
    return Pairs(keys[place], s.symbols[at[place]], of, np.concatenate([np.arange(n), n + longer, 2 * n + longest])[place])


def training_counts(s: Stream, p: Pairs, training: np.ndarray) -> np.ndarray:
    """How often training texts have each pair; a context that is one with the next shorter one counts once."""
    own = np.repeat(training, np.diff(s.bounds))
    first, second, third = s.contexts
    weights = np.concatenate([own, own * (first != second), own[s.at_byte] * (second[s.at_byte] != third)])
    return np.bincount(p.of, weights=weights, minlength=len(p.symbols)).astype(np.uint32)


def rare_words(s: Stream) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the words that are no symbols, ascending, and the number of each such word."""
    rare = s.words[s.known < 0]
    place, of = _dense(rare)
    return rare[place], of


# ---- a range's counts


def answers(code: Code, keys: np.ndarray, counts: np.ndarray) -> tuple[Runs, np.ndarray]:
    """Turns to 1 and to 0 at the nodes on the path of each distinct pair, and the pair's number for every given one."""
    place, of = _dense_pairs(keys)
    key = keys[place]
    symbol = code.of_leaf[(key & ((np.uint64(1) << LEAF_BITS) - np.uint64(1))).astype(np.int64)]
    context = key >> LEAF_BITS << LEAF_BITS
    own = np.bincount(of, weights=counts, minlength=len(key)).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(own)])
    lengths, starts = code.lengths[symbol], code.starts[symbol]
    out_at = np.concatenate([[0], np.cumsum(lengths)])
    # What holds where a pair is the only one left: all of its own count takes its own turn.
    alone = turn_codes(own, np.zeros_like(own))
    values = np.where(code.bits[_paths(starts, lengths)] == 1, np.repeat(alone, lengths), np.repeat(OTHER_WAY[alone], lengths))
    # Pairs of a context and tree stand in the order of its leaves, so those that are on the same side of all nodes
    # down to a depth are runs: neighbours part where their paths do.
    parted = np.full(len(key), -1, np.int8)
    tree = symbol >= code.end + 2
    beside = np.flatnonzero((context[1:] == context[:-1]) & (tree[1:] == tree[:-1])) + 1
    parted[beside] = shared_turns(code, symbol[beside], symbol[beside - 1])
    active, depth = np.arange(len(key)), -1
    while True:
        first = np.flatnonzero(parted[active] <= depth)
        sizes = np.diff(np.append(first, len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
        sizes, depth = sizes[sizes > 1], depth + 1
        if not len(active):
            break
        lo = active[np.cumsum(sizes) - sizes]
        hi = lo + sizes
        # Without a parting at this node all are on one side of it.
        middle = np.where(code.bits[starts[lo] + depth] == 1, lo, hi)
        split = np.flatnonzero(parted[active] == depth)
        middle[np.searchsorted(lo, active[split], side="right") - 1] = active[split]
        values[out_at[active] + depth] = np.repeat(turn_codes(upto[hi] - upto[middle], upto[middle] - upto[lo]), sizes)
    runs = Runs()
    runs.values, runs.starts, runs.lengths = values, out_at[:-1], lengths
    return runs, of


def first_new(code: Code, keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """For ascending pairs: from which depth on the nodes of a path are not those of the pair before."""
    out = np.zeros(len(symbols), np.int64)
    words = code.end + 2
    same = (keys[1:] >> LEAF_BITS == keys[:-1] >> LEAF_BITS) & ((symbols[1:] >= words) == (symbols[:-1] >= words))
    same = np.flatnonzero(same) + 1
    out[same] = shared_turns(code, symbols[same], symbols[same - 1]) + 1
    return out


def turned(code: Code, symbols: np.ndarray, new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Turns to 1 and to 0 at the new nodes as the turns that each pair takes and the others, which are much alike and
    pack well; and back, as this is its own inverse."""
    taken = code.bits[_paths(code.starts[symbols] + new, np.maximum(code.lengths[symbols] - new, 0))] == 1
    return np.where(taken, values, OTHER_WAY[values])


def restored(code: Code, p: Pairs, nodes: np.ndarray) -> Runs:
    """The turn taken and the other at each node of all pairs' paths, from those of the new nodes alone."""
    new, lengths = first_new(code, p.keys, p.symbols), code.lengths[p.symbols]
    nodes = turned(code, p.symbols, new, nodes)
    turns = Runs()
    turns.lengths, turns.starts = lengths, np.cumsum(lengths) - lengths
    sent = np.cumsum(np.maximum(lengths - new, 0)) - np.maximum(lengths - new, 0)
    values = np.zeros(int(lengths.sum()), np.uint8)
    active, depth = np.arange(len(lengths)), 0
    while len(active):
        is_new = new[active] <= depth
        source = active[np.maximum.accumulate(np.where(is_new, np.arange(len(active)), 0))]
        values[turns.starts[active] + depth] = nodes[sent[source] + depth - new[source]]
        depth += 1
        active = active[lengths[active] > depth]
    taken = code.bits[_paths(code.starts[p.symbols], lengths)] == 1
    turns.values = np.where(taken, values, OTHER_WAY[values])
    return turns


# ---- mixing


def _own_match(code: Code, s: Stream) -> tuple[np.ndarray, np.ndarray]:
    """How many turns the symbol that followed last in the text's own context shares with each symbol (-1: there is
    none), and how many times in a row (RUNS - 1 at most) such symbols were right before."""
    n = len(s.symbols)
    text = np.repeat(np.arange(len(s.bounds) - 1, dtype=np.uint64), np.diff(s.bounds))
    key = mix(s.own + text * ODD)
    order = order_of(key)
    ranked = key[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    shared = np.full(n, -1, np.int8)
    now, before = s.symbols[order[same]], s.symbols[order[same - 1]]
    shared[order[same]] = np.where(now == before, code.lengths[now], shared_turns(code, now, before))
    right = np.zeros(n, bool)
    right[order[same]] = now == before
    miss = np.where(right, -1, np.arange(n))
    miss[s.bounds[:-1]] = s.bounds[:-1]  # a text starts anew
    np.maximum.accumulate(miss, out=miss)
    run = np.zeros(n, np.int64)
    run[1:] = np.arange(n - 1) - miss[:-1]
    run[s.bounds[:-1]] = 0
    return shared, np.minimum(run, RUNS - 1).astype(np.int8)


def corpus_odds(code: Code, s: Stream, p: Pairs, turns: Runs) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Where each symbol's turns begin, and at each turn the log odds by the corpus contexts, from short to long,
    and the set of weights. Symbols with the same longest context and so the same turns share one run of them."""
    n = len(s.symbols)
    share = code.share[_paths(code.starts[p.symbols], turns.lengths)]
    # Longer contexts back off to the next shorter one of the place, which is done before them.
    for low, high in ((n, 2 * n), (2 * n, 2 * n + len(s.at_byte))):
        longer = np.flatnonzero((p.place >= low) & (p.place < high))
        place = p.place[longer] - low
        shorter = p.of[place if low == n else n + s.at_byte[place]]
        own, base = _paths(turns.starts[longer], turns.lengths[longer]), _paths(turns.starts[shorter], turns.lengths[longer])
        values = turns.values[base]
        share[own] = (TURN_ON[values] + BACK_OFF * share[base]) / (TURN_SUM[values] + BACK_OFF)
    on = TURN_ON[turns.values]
    on += BACK_OFF * share
    off = TURN_OFF[turns.values]
    off += BACK_OFF * (1 - share)
    on /= off
    odds = np.log(on, out=on)
    longest = p.of[n : 2 * n].copy()
    longest[s.at_byte] = p.of[2 * n :]
    at = np.full(len(p.symbols), -1)
    at[longest[::-1]] = np.arange(n)[::-1]
    used = np.flatnonzero(at >= 0)
    at, lengths = at[used], turns.lengths[used]
    starts = np.zeros(len(p.symbols), np.int64)
    starts[used] = np.cumsum(lengths) - lengths
    path = _paths(code.starts[p.symbols[used]], lengths)
    is_byte = p.symbols[used] >= code.end + 2
    first = odds[_paths(turns.starts[p.of[at]], lengths)]
    x = [np.where(np.repeat(is_byte, lengths), first, code.odds[path]), first, odds[_paths(turns.starts[used], lengths)]]
    own = np.flatnonzero(np.repeat(is_byte, lengths))
    x[1][own] = odds[_paths(turns.starts[p.of[n + at[is_byte]]], lengths[is_byte])]
    return starts[longest], x, code.gates[path]


# What the text's own match says of a turn: nothing, against it, for it; after 0, 1, 2 or more matches in a row.
MATCH_INPUT = np.stack([0 * MATCH_ODDS, -MATCH_ODDS, MATCH_ODDS], 1).ravel()
MATCH_GATE = np.repeat(np.arange(RUNS), 3).clip(1)
MATCH_GATE[::3] = 0


def mixed(code: Code, s: Stream, p: Pairs, turns: Runs) -> np.ndarray:
    """ln probability of each text of the block; ``turns`` are those at the nodes of the pairs' paths."""
    out = np.zeros(len(s.bounds) - 1)
    shared, run = _own_match(code, s)
    begin, x, gates = corpus_odds(code, s, p, turns)
    sizes = np.diff(s.bounds)
    tile = 0
    while tile < len(sizes):  # consecutive texts with about TILE symbols
        stop = max(tile + 1, int(np.searchsorted(s.bounds, s.bounds[tile] + TILE, side="right")) - 1)
        docs = tile + np.argsort(-sizes[tile:stop], kind="stable")
        out[docs] = _mixed_tile(code, s, x, gates, begin, shared, run, docs)
        tile = stop
    return out


def _mixed_tile(code: Code, s: Stream, odds, gates, begin, shared, run, docs: np.ndarray) -> np.ndarray:
    """``docs`` are ordered by falling size, so that those with a further segment come first."""
    sizes, first = np.diff(s.bounds)[docs], s.bounds[docs]
    out = np.zeros(len(docs))
    weights = np.repeat(np.array(FIRST_WEIGHTS, np.float32)[:, None], len(docs) * GATES, axis=1)
    bend = np.full(len(docs) * GATES, WEIGHT_PRIOR, np.float32)
    tilt, tilt_bend = np.zeros(len(docs) * BUCKETS, np.float32), np.full(len(docs) * BUCKETS, MAP_PRIOR, np.float32)
    cut, end = 0, next_cut(0)
    while live := int(np.searchsorted(-sizes, -cut, side="left")):
        going = int(np.searchsorted(-sizes, -end, side="left"))
        length = np.minimum(end, sizes[:live]) - cut
        at = _paths(first[:live] + cut, length)
        cut, end = end, next_cut(end)
        n_bits = code.lengths[s.symbols[at]]
        upto = np.cumsum(n_bits)
        event = np.arange(int(upto[-1]))
        turn = event + np.repeat(begin[at] - upto + n_bits, n_bits)
        # All log odds are those of the turn taken, so the wanted outcome is always 1.
        x = [v[turn] for v in odds]
        # Turns that the guess still shares: more than none speaks for the turn taken, none against it.
        left = np.repeat(shared[at] + upto - n_bits, n_bits)
        left -= event
        np.minimum(np.maximum(left, -1, out=left), 1, out=left)
        left += np.repeat(run[at] * 3 + 1, n_bits)
        x.append(MATCH_INPUT[left])
        doc_bits = np.add.reduceat(n_bits, np.cumsum(length) - length)
        key = np.repeat(np.arange(live) * GATES, doc_bits)
        key += gates[turn]
        key += MATCH_GATE[left]
        z = weights[0][key]
        z *= x[0]
        for i in range(1, INPUTS):
            more = weights[i][key]
            more *= x[i]
            z += more
        np.minimum(np.maximum(z, np.float32(-11.9), out=z), np.float32(11.9), out=z)
        # The map adds to the size of the log odds, whichever turn they favour.
        bucket = np.repeat(np.arange(live) * BUCKETS, doc_bits)
        bucket += (np.abs(z) * np.float32(BUCKETS / 12)).astype(np.int64)
        side = np.copysign(np.float32(1), z)
        z += side * tilt[bucket]
        chance = 1 / (1 + np.exp(-z))
        out[:live] += np.add.reduceat(np.log(chance), np.cumsum(doc_bits) - doc_bits, dtype=np.float64)
        if going:
            m = int(doc_bits[:going].sum())
            error, key, bucket = 1 - chance[:m], key[:m], bucket[:m]
            curve = chance[:m] * error
            x = [v[:m] for v in x]
            size = sum(v * v for v in x)
            size *= curve
            bend += np.bincount(key, weights=size, minlength=len(bend))
            for i in range(INPUTS):
                weights[i] += np.bincount(key, weights=error * x[i], minlength=len(bend)) / bend
            tilt_bend += np.bincount(bucket, weights=curve, minlength=len(tilt))
            tilt += np.bincount(bucket, weights=error * side[:m], minlength=len(tilt)) / tilt_bend
    return out


# ---- Spark


def _packed(data: np.ndarray) -> bytes:
    """Compressed byte plane by byte plane, as the leading bytes of small or sorted numbers are alike."""
    planes = np.ascontiguousarray(data).view(np.uint8).reshape(-1, data.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _word_counts(parts: int):
    """Per task: packed counts of word hashes, dealt by their leading bits, and of bytes (then documents)."""
    bits = parts.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(257, np.int64)
        held, size = [], 0

        def rows(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["part", "keys", "counts"])

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted((keys >> np.uint64(64 - bits)).astype(np.int64), np.arange(parts + 1))
            return rows([(p, _packed(_steps(keys[a:b])), _packed(counts[a:b].astype(np.int64))) for p, a, b in zip(range(parts), cut[:-1], cut[1:]) if a < b])

        for batch in batches:
            for block in blocks(batch):
                data, offsets = text_bytes(block.column(0))
                starts, ends, _ = word_bounds(data, offsets)
                held.append(word_hashes(data, starts, ends))
                size += len(starts)
                totals[:256] += np.bincount(LOWER[data], minlength=256)
                totals[256] += block.num_rows
                if size >= 1 << 21:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        if totals[256]:
            totals[[9, 10, 11, 12, 13, 32]] = 0  # between words
            yield rows([(0, b"", _packed(totals))])

    return run


def _merged_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a part's words; the totals of the part that has them as kind 1, numbered from 0."""
    keys, counts, totals = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(257, np.int64)
    more, size = [], 0

    def merged():
        k, n = np.concatenate([keys, *(a for a, _ in more)]), np.concatenate([counts, *(b for _, b in more)])
        place, of = _dense(k)
        return k[place], np.bincount(of, weights=n, minlength=len(place)).astype(np.int64)

    for batch in batches:
        for k, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if k:
                more.append((_summed(k, np.uint64), _unpacked(n, np.int64)))
                size += len(more[-1][0])
            else:
                totals += _unpacked(n, np.int64)
        if size > max(1 << 20, len(keys)):
            keys, counts = merged()
            more, size = [], 0
    keys, counts = merged()
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], ["kind", "word", "n"])
    if totals.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(257, np.int32)), pa.array(np.arange(257)), pa.array(totals)], ["kind", "word", "n"])


def train(docs: DataFrame, training: Column) -> Code:
    """The code of those ``docs`` (text) for which ``training`` holds; all their words are counted."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = _parts(spark)
    texts = docs.where(training).select(F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_word_counts(parts), "part int, keys binary, counts binary")
    counted, path = write_shared(counted.repartitionById(parts, "part").mapInArrow(_merged_words, "kind int, word long, n long"), "lm-words")
    totals = np.zeros(257, np.int64)
    for row in counted.where("kind = 1").collect():  # 257 rows
        totals[row["word"]] += row["n"]
    words = counted.where("kind = 0")
    level = F.floor(F.log2("n") * 8).cast("int")
    tokens, distinct, start, total = int(totals[256]), int(totals[256] > 0), 1 << 20, 0
    for row in words.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():  # 504 rows at most
        tokens, distinct, total = tokens + row["n"], distinct + row["rows"], total + row["rows"]
        start = row["level"] if total <= VOCABULARY and row["least"] >= LEAST_COUNT else start
    top = words.where(level >= start).select("word", "n").toArrow()  # VOCABULARY rows at most
    drop_shared(spark, path)
    keys, counts = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(keys)
    return make_code(keys[order], counts[order], totals[:256], tokens, distinct, int(totals[256]))


def _parts(spark: SparkSession) -> int:
    """Ranges of hashes, a power of two: eight times the shuffle partitions or more."""
    return 1 << max(4, (8 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def _blocks(block_bytes: int, per_bundle: int):
    """Rows of (bundle, block, ids, training, offsets, texts): consecutive texts of about so many bytes, or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row():
            table = pa.Table.from_batches(held).combine_chunks()
            data, offsets = text_bytes(table.column(1))
            ids = table.column(0).combine_chunks()
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            training = np.array(table.column(2).to_pylist(), np.uint8)
            bundle = block // per_bundle
            return pa.RecordBatch.from_arrays([pa.array([bundle], pa.int64()), pa.array([block], pa.int64()), listed, *(pa.array([_packed(x)], pa.binary()) for x in (training, offsets, data))], ["bundle", "block", "ids", "training", "offsets", "texts"])

        for batch in batches:
            for part in blocks(batch, "text", block_bytes // 8):
                n = len(text_bytes(part.column(1))[0])
                if held and size + n > block_bytes:
                    yield row()
                    block, held, size = block + 1, [], 0
                held.append(part)
                size += n
        if held:
            yield row()

    return run


def _stream_of(code: Code, row) -> tuple[Stream, np.ndarray, np.ndarray]:
    """Symbols of a stored block, which of its texts are training texts, and the texts' bounds."""
    offsets = _unpacked(row["offsets"].as_py(), np.int64)
    return stream(code, _unpacked(row["texts"].as_py(), np.uint8), offsets), _unpacked(row["training"].as_py(), np.uint8), offsets


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _summed(data: bytes, kind) -> np.ndarray:
    return np.cumsum(_unpacked(data, kind), dtype=kind)


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each range of ascending hashes begins (total last)."""
    return np.append(np.searchsorted(keys, np.arange(parts, dtype=np.uint64) << np.uint64(64 - parts.bit_length() + 1)), len(keys))


def _requests(shared, parts: int):
    names = ["part", "bundle", "block", "keys", "counts", "words", "word_counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for batch in batches:
            for row in pa.Table.from_batches([batch]).to_batches(max_chunksize=1):
                row = {c: row.column(i)[0] for i, c in enumerate(row.schema.names)}
                s, training, _ = _stream_of(code, row)
                p = pairs(code, s)
                counts = training_counts(s, p, training)
                words, of = rare_words(s)
                own = np.repeat(training, s.n_words)[s.known < 0]
                word_counts = np.bincount(of, weights=own, minlength=len(words)).astype(np.uint32)
                cut, word_cut = _ranges(p.keys, parts), _ranges(words, parts)
                out = []
                for i in range(parts):
                    a, b, c, d = cut[i], cut[i + 1], word_cut[i], word_cut[i + 1]
                    if a < b or c < d:
                        columns = (_steps(p.keys[a:b]), counts[a:b], _steps(words[c:d]), word_counts[c:d])
                        out.append((i, row["bundle"].as_py(), row["block"].as_py(), *map(_packed, columns)))
                if out:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def _answered(shared):
    """Answers to the requests of one range, which are held together: every block's in the order it asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        where, keys, counts, words, word_counts = [], [], [], [], []
        for batch in batches:
            for *place, k, n, w, m in zip(*(batch.column(i).to_pylist() for i in range(7))):
                keys.append(_summed(k, np.uint64))
                counts.append(_unpacked(n, np.uint32))
                words.append(_summed(w, np.uint64))
                word_counts.append(_unpacked(m, np.uint32))
                where.append(place)
        if not where:
            return
        runs, of = answers(code, np.concatenate(keys), np.concatenate(counts))
        place, word_of = _dense(np.concatenate(words))
        total = np.bincount(word_of, weights=np.concatenate(word_counts), minlength=len(place)).astype(np.int64)
        a = c = 0
        leaf = (np.uint64(1) << LEAF_BITS) - np.uint64(1)
        for (part, bundle, block), x, y in zip(where, keys, words):
            symbols, pair = code.of_leaf[(x & leaf).astype(np.int64)], of[a : a + len(x)]
            new = first_new(code, x, symbols)
            turns = turned(code, symbols, new, runs.values[_paths(runs.starts[pair] + new, np.maximum(runs.lengths[pair] - new, 0))])
            own = total[word_of[c : c + len(y)]]
            yield pa.RecordBatch.from_arrays([pa.array([bundle], pa.int64()), pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([_packed(turns)], pa.binary()), pa.array([_packed(own)], pa.binary())], ["bundle", "block", "part", "turns", "word_counts"])
            a, c = a + len(x), c + len(y)

    return run


def _scored(shared, id_type: pa.DataType):
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"]

    def run(bundle: pa.Table, answered: pa.Table) -> pa.Table:
        own = answered.column("block").to_numpy()
        rows = [{c: bundle.column(c)[i] for c in bundle.column_names} for i in range(bundle.num_rows)]
        return pa.concat_tables([block(row, answered.filter(pa.array(own == row["block"].as_py()))) for row in rows])

    def block(row: dict, answered: pa.Table) -> pa.Table:
        code = shared.value
        s, _, offsets = _stream_of(code, row)
        p = pairs(code, s)
        order = np.argsort(answered.column("part").to_numpy())
        joined = lambda c, kind: np.concatenate([np.zeros(0, kind), *(_unpacked(answered.column(c)[int(i)].as_py(), kind) for i in order)])
        ln = mixed(code, s, p, restored(code, p, joined("turns", np.uint8)))
        floor = math.log10(code.tokens + 0.1 * (code.distinct + 1)) if code.tokens else math.log10(0.1)
        count = np.zeros(len(s.words), np.int64)
        count[s.known >= 0] = code.counts[s.known[s.known >= 0]]
        count[s.known < 0] = joined("word_counts", np.int64)[rare_words(s)[1]]
        doc = np.repeat(np.arange(len(s.n_words)), s.n_words)
        base = np.bincount(doc, weights=np.log10(count + 0.1) - floor, minlength=len(s.n_words)) + math.log10(code.documents + 0.1) - floor
        known = np.bincount(doc, weights=count > 0, minlength=len(s.n_words)).astype(np.int64) + (code.documents > 0)
        bits = -ln / math.log(2) / np.maximum(np.diff(offsets), 1)
        ids = pa.array(row["ids"].values, id_type)
        return pa.table([ids, pa.array(s.n_words + 1), pa.array(known), pa.array(base), pa.array(ln / math.log(10)), pa.array(bits)], names=names)

    return run


def lm_scores(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs`` (doc_id, text).

    The model learns from the rows for which ``training`` (over the columns of ``docs``; null: no) holds.
    Null texts and texts without words consist of the end alone. Repeated rows stay repeated and count
    each; equal texts have equal scores. Without training rows everything is predicted from nothing; an
    empty table gives an empty result. Other columns are ignored. A very long text is a block of its own,
    whose arrays take some fifty times its bytes in one worker; mixing itself goes by segments.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    training = F.coalesce(training, F.lit(False))
    code = spark.sparkContext.broadcast(train(docs, training))
    parts = _parts(spark)
    id_field = docs.select("doc_id").schema[0].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), training.alias("training"))
    packed = rows.mapInArrow(_blocks(BLOCK_BYTES, BUNDLE), f"bundle long, block long, ids array<{id_field}>, training binary, offsets binary, texts binary")
    # Bucketed, so that texts are not shuffled when their answers come back to them.
    table, buckets = f"lm_blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed.write.format("parquet").bucketBy(buckets, "bundle").option("path", new_path(spark, "lm-blocks")).saveAsTable(table)
    packed = spark.table(table)
    asked = packed.mapInArrow(_requests(code, parts), "part int, bundle long, block long, keys binary, counts binary, words binary, word_counts binary")
    answered = asked.repartitionById(parts, "part").mapInArrow(_answered(code), "bundle long, block long, part int, turns binary, word_counts binary")
    from pyspark.sql.pandas.types import to_arrow_type

    run = _scored(code, to_arrow_type(docs.schema["doc_id"].dataType))
    scored = packed.groupBy("bundle").cogroup(answered.groupBy("bundle")).applyInArrow(run, f"doc_id {id_field}, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return scored.withColumn("train_tokens", F.lit(code.value.tokens).cast("long"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = in_fold("doc_id", 10, 0)
    scored = lm_scores(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES = {"op3_lm_scores": op3_lm_scores}
