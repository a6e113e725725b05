"""Language identification by cross-parsing entropy (Ziv and Merhav, 1993).

Labelled text of each language becomes a suffix automaton. A text is parsed from left to right into the longest
phrases that occur in a language's text; few phrases mean little cross entropy. The language with the fewest
normalised phrases, phrases * log2(size of its text) / length, wins (first in code point order on ties).

Each distinct letter of the learning texts has its own code; letters that none of them holds share OTHER. An
automaton knows the letters of its own language and takes all others as OTHER, which its text never holds.

The automaton is followed from its root only, so one table row per state holds all moves: the next state, or,
where no phrase goes on, the root's move and a flag that a phrase begins. Where the full tables of all languages would
be over DENSE_BYTES, or one has over WIDE letters, the moves that go on are kept as sorted keys instead, with the same
result. Every whole text is parsed as one sequence: its BLOCK-character blocks advance together, one numpy step a
character, and a block's first phrases are then parsed again from the state the block before it ends in, until both
parses begin a phrase at one place (`phrases`).

Learning is bounded by documented parameters: whole texts of up to ROWS documents a language and ROW_CHARS characters
each, in the order of a hash of doc_id (longer ones after these, the shortest first), from rows that are not held out (one text of a repeated doc_id), up to
TOTAL_CHARS / languages and TEXT_CHARS characters a language; MAX_LANGS languages. A language whose texts are all
longer is learned from the shortest of them, whole.

Defined results: null text and text without a letter give `und` and score 0; with nothing learned every text is
`und` (has_letter tells the two apart); repeated rows give repeated rows; lang and source are never read for predictions; other
columns stay as they are, whatever their names; an empty table gives no rows. score = 1 - best / second best normalised phrase count (1 where one language is known).
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import append, held_out

ROWS = 128
ROW_CHARS = 8_000
TEXT_CHARS = 40_000
TOTAL_CHARS = 2_000_000
MAX_LANGS = 200
#: Parts of a language that are ranked apart first.
PARTS = 32
#: Letters up to which an automaton is a full table, and bytes of all full tables together.
WIDE = 128
DENSE_BYTES = 96 << 20
BLOCK = 512
#: Texts taken together, and codes parsed at once (a longer text is parsed alone).
TOGETHER = 2048
GROUP = 1 << 22
FLAG = 1 << 30
PAD, GAP, OTHER = 0, 1, 2


def labelled_text(docs: DataFrame) -> dict[str, str]:
    """language -> bounded labelled text, from rows that are not held out."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    size, digest = F.char_length("text"), F.xxhash64("text")
    one = rows.groupBy("lang", "doc_id").agg(F.min(F.struct(size.alias("n"), digest.alias("d"))).alias("t"))
    order = [F.greatest(F.col("t.n"), F.lit(ROW_CHARS)), F.xxhash64("doc_id"), "doc_id"]
    ranked = one.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)))
    for keys in (("lang", "part"), ("lang",)):  # first inside parts of a language, so that one language is not one task
        ranked = ranked.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("i") <= ROWS)
    ids = ranked.select("lang", "doc_id", "t.n", "t.d", "i").orderBy("lang", "i").limit(ROWS * MAX_LANGS + 1).collect()
    langs = {r["lang"] for r in ids}
    if len(langs) > MAX_LANGS or len(ids) > ROWS * MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not ids:
        return {}
    most, used, chosen = min(TEXT_CHARS, TOTAL_CHARS // len(langs)), dict.fromkeys(langs, 0), []
    for r in ids:
        if not used[r["lang"]] or r["n"] <= ROW_CHARS and used[r["lang"]] + r["n"] <= most:
            used[r["lang"]] += r["n"]
            chosen.append((r["lang"], r["doc_id"], r["d"]))
    kinds = dict(docs.dtypes)
    wanted = docs.sparkSession.createDataFrame(chosen, f"lang {kinds['lang']}, doc_id {kinds['doc_id']}, d long")
    texts = rows.withColumn("d", digest).join(F.broadcast(wanted), ["lang", "doc_id", "d"], "left_semi")
    sample = texts.groupBy("lang", "doc_id").agg(F.min("text").alias("t")).collect()
    by_lang: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], str(r["doc_id"]))):
        by_lang.setdefault(r["lang"], []).append(r["t"])
    return {lang: " ".join(own) for lang, own in by_lang.items()}


def alphabet(texts: dict[str, str]) -> np.ndarray:
    """Code of every code point: GAP for what is no letter, OTHER for letters never seen, one for each letter of `texts`."""
    seen = sorted({c for t in texts.values() for c in t.lower() if c.isalpha()})
    table = np.full(sys.maxunicode + 1, GAP, dtype=np.min_scalar_type(OTHER + len(seen)))
    table[[i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]] = OTHER
    for k, c in enumerate(seen):
        table[ord(c)] = OTHER + 1 + k
    return table


def encode(text: str | None, table: np.ndarray) -> np.ndarray:
    """Codes of the lower-cased text, runs of GAP as one."""
    if not text:
        return np.zeros(0, dtype=table.dtype)
    codes = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    gap = codes == GAP
    return codes[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]


def suffix_automaton(codes: np.ndarray, n_codes: int, dense_bytes: int = DENSE_BYTES) -> tuple:
    """(own code of each code, width, root's moves, moves, keys) of the suffix automaton of `codes`.

    Without keys, moves[state * width + own code] is the next state, or FLAG and the root's move. With keys, moves[i]
    is the next state of keys[i] = state * width + own code; where there is no key, FLAG and the root's move hold.
    The last state is where parsing starts and where a symbol leads that the text lacks: each symbol there begins a phrase.
    """
    letters = np.unique(codes[codes > OTHER])
    width = OTHER + 1 + len(letters)
    own = np.full(n_codes, OTHER, dtype=np.min_scalar_type(width))
    own[[PAD, GAP]] = PAD, GAP
    own[letters] = np.arange(OTHER + 1, width)
    codes = own[codes]
    moves, link, length, last = [{}], [-1], [0], 0
    for c in codes.tolist():
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    start = len(moves)
    root = np.full(width, start, dtype=np.int32)
    for c, s in moves[0].items():
        root[c] = s
    root |= FLAG
    if len(letters) > WIDE or (start + 1) * width * 4 > dense_bytes:
        on = sorted((s * width + c, t) for s, m in enumerate(moves) for c, t in m.items())
        return own, width, root, np.array([t for _, t in on], dtype=np.int32), np.array([k for k, _ in on], dtype=np.int64)
    table = np.tile(root, (start + 1, 1))
    for s, m in enumerate(moves):
        for c, t in m.items():
            table[s, c] = t
    table[:, PAD] = np.arange(start + 1)
    return own, width, root, table.ravel(), None


def learn(texts: dict[str, str]):
    """(languages, alphabet table, automata, log2 sizes)."""
    langs, table = sorted(texts), alphabet(texts)
    coded = [encode(texts[x], table) for x in langs]
    n_codes = int(table.max()) + 1 if langs else 0
    return langs, table, [suffix_automaton(c, n_codes, DENSE_BYTES // max(1, len(langs))) for c in coded], [float(np.log2(max(2, len(c)))) for c in coded]


def _step(automaton: tuple, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a phrase begins) of parses in `state` at the symbols `code`."""
    _, width, root, moves, keys = automaton
    if keys is None:
        step = moves.take(state.astype(np.int64) * width + code)
        return step & (FLAG - 1), step >> 30
    step = root.take(code)
    at = np.flatnonzero((code != PAD) & (code != OTHER) & (state != (int(root[OTHER]) & (FLAG - 1))))
    wanted = state[at].astype(np.int64) * width + code[at]
    found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[found] == wanted
    step[at[hit]] = moves[found[hit]]
    return np.where(code == PAD, state, step & (FLAG - 1)), np.where(code == PAD, 0, step >> 30)


def phrases(blocks: np.ndarray, automaton: tuple, goes_on: np.ndarray | None = None) -> np.ndarray:
    """Phrases of each block; blocks: [position, block] codes. `goes_on`: whether a block continues the one before it.

    All blocks are parsed from the start state at first. A block that continues another is parsed again from the
    state that one ends in, until both parses begin a phrase at the same place: from there on they are the same. If
    they never meet, the block ends in another state than assumed, and the block after it is parsed again in turn.
    """
    own, root = automaton[0], automaton[2]
    blocks = own.take(blocks)
    start = int(root[OTHER]) & (FLAG - 1)
    n = blocks.shape[1]
    count, state = np.zeros(n, dtype=np.int32), np.full(n, start, dtype=np.int32)
    flags = np.zeros(blocks.shape, dtype=np.int8)
    if automaton[4] is None:
        width, moves = automaton[1], automaton[3]
        state = state.astype(np.int32 if len(moves) < 1 << 31 else np.int64)
        for i, code in enumerate(blocks):
            state *= width
            state += code
            step = moves.take(state)
            np.right_shift(step, 30, out=flags[i], casting="unsafe")
            count += flags[i]
            np.bitwise_and(step, FLAG - 1, out=state, casting="unsafe")
    else:
        for i, code in enumerate(blocks):
            state, begins = _step(automaton, state, code)
            flags[i] = begins
            count += flags[i]
    if goes_on is None:
        return count
    plain, alone, ends, todo = count.copy(), state.astype(np.int64), state.astype(np.int64), np.flatnonzero(goes_on)
    while len(todo):
        now, at, more = ends[todo - 1], todo, np.zeros(n, dtype=np.int32)
        for i, code in enumerate(blocks):
            now, begins = _step(automaton, now, code[at])
            more[at] += begins - flags[i, at]
            apart = (begins & flags[i, at]) == 0
            at, now = at[apart], now[apart]
            if not len(at):
                break
        count[todo] = plain[todo] + more[todo]
        new = alone.copy()
        new[at] = now  # those that never met
        changed = todo[new[todo] != ends[todo]] + 1
        ends[todo] = new[todo]
        todo = changed[changed < n]
        todo = todo[goes_on[todo]]
    return count


def predict(texts: list[str | None], model) -> tuple[list[str], list[float]]:
    return parse(texts, model)[:2]


def parse(texts: list[str | None], model) -> tuple[list[str], list[float], list[bool]]:
    """Language, score, and whether there is a letter, of each text."""
    table = model[1]
    out: tuple[list, list, list] = ([], [], [])
    group, size = [], 0
    for k, t in enumerate(texts):
        group.append(encode(t, table))
        size += len(group[-1])
        if size >= GROUP or k == len(texts) - 1:
            for whole, part in zip(out, _parse(group, model)):
                whole += part
            group, size = [], 0
    return out


def _parse(codes: list[np.ndarray], model) -> tuple[list[str], list[float], list[bool]]:
    langs, table, automata, logs = model
    letters = [bool((c > GAP).any()) for c in codes]
    n_blocks = np.array([-(-len(c) // BLOCK) if ok else 0 for c, ok in zip(codes, letters)])
    total = int(n_blocks.sum())
    if not langs or not total:
        return ["und"] * len(codes), [0.0] * len(codes), letters
    flat = np.zeros(total * BLOCK, dtype=table.dtype)
    first = np.concatenate(([0], np.cumsum(n_blocks)))
    for c, k, n in zip(codes, first, n_blocks):
        if n:
            flat[k * BLOCK : k * BLOCK + len(c)] = c
    blocks = np.ascontiguousarray(flat.reshape(total, BLOCK).T)
    owner = np.repeat(np.arange(len(codes)), n_blocks)
    goes_on = np.concatenate(([False], owner[1:] == owner[:-1]))
    rates = np.stack([np.bincount(owner, phrases(blocks, m, goes_on), len(codes)) * g for m, g in zip(automata, logs)])
    order = np.argsort(rates, axis=0, kind="stable")
    best = np.take_along_axis(rates, order, 0)
    score = 1 - best[0] / np.maximum(best[1], 1e-9) if len(langs) > 1 else np.ones(len(codes))
    return (
        [langs[i] if ok else "und" for i, ok in zip(order[0], letters)],
        [float(min(1.0, max(0.0, s))) if ok else 0.0 for s, ok in zip(score, letters)],
        letters,
    )


def identify(docs: DataFrame, prefix: str = "") -> DataFrame:
    """All columns of `docs`, held_out, lang_pred, score and has_letter (the last four with `prefix`)."""
    model = docs.sparkSession.sparkContext.broadcast(learn(labelled_text(docs)))
    fields = [(f"{prefix}lang_pred", "string"), (f"{prefix}score", "double"), (f"{prefix}has_letter", "boolean")]
    return append(docs, lambda texts: parse(texts, model.value), fields, TOGETHER).withColumn(f"{prefix}held_out", held_out(F.col("doc_id")))
