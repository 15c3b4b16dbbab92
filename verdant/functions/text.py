"""Text expressions: tokens, normal form, language, masking of secrets, crop entities; the chunker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdant import constants as K


def tokens(text: Column) -> Column:
    """Lower-case runs of the token alphabet with two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(K.TOKEN_PATTERN.removesuffix("+") + "{2,}"), F.lit(0))


def normalise(text: Column) -> Column:
    """Lower case, outer blanks off, runs of any blank to one space."""
    collapsed = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    return F.trim(collapsed)


#: Steps of a fold within a fold. Spark copies a fold's state at every step, so the long list of cuts is only touched once a block.
BLOCK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, and not copied as ``transform`` would."""
    return F.aggregate(F.array(F.lit(0)), value, lambda known, _: known, use)


def _state(at: Column, kept: Column, cuts: Column) -> Column:
    # A field that Spark holds for never NULL in one state and not in the next would be cast at every step.
    return F.struct(*[F.get(F.array(value), F.lit(0)).alias(name) for name, value in (("at", at), ("kept", kept), ("cuts", cuts))])


def chunks(text: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, mode: str = "reference") -> Column:
    """Array of chunks of at most ``size`` characters of the text with single blanks.

    A window is cut behind its last sentence if that is longer than ``K.MIN_SENTENCE_CUT``, else at its last
    blank, else at its end; the last window is taken whole. The next window begins ``overlap`` before the end of
    the last one or behind the cut, whichever is later; with ``mode="overlap"`` it begins ``overlap`` before the
    cut, so that no text is passed over. The text is cut into segments of ``size`` once, so a window is the end of
    one and the start of the next, wherever it lies; the fold over the windows takes time in proportion to the text.
    """
    least = 1 if mode == "overlap" else size - overlap

    def taken(window: Column) -> Column:
        def before_last(mark: str) -> Column:
            return F.length(window) - F.length(F.substring_index(window, mark, -1)) - len(mark)

        word = _let(before_last(" "), lambda n: F.when(n > 0, n).otherwise(F.length(window)))
        return _let(before_last(". "), lambda n: F.when(n > K.MIN_SENTENCE_CUT, n).otherwise(word))

    def cut(known: Column) -> Column:
        whole, segments = known["whole"], known["segments"]

        def window(at: Column) -> Column:
            first = F.floor(at / size).cast("int")
            both = F.concat(F.get(segments, first), F.coalesce(F.get(segments, first + 1), F.lit("")))
            return F.substring(both, at % size + 1, F.lit(size))

        def onward(state: Column) -> Column:
            at, kept = state["at"], state["kept"]
            behind = F.greatest(kept - overlap, F.lit(1)) if mode == "overlap" else F.greatest(kept + 1, F.lit(least))
            return F.when(kept < 0, F.lit(0)).when(at + kept >= whole, whole).otherwise(at + behind)

        def grow(state: Column, _: Column) -> Column:
            def go(at: Column) -> Column:
                kept = F.when(whole - at <= size, whole - at).otherwise(_let(window(at), taken))
                told = lambda n: _state(at, n, F.concat(state["cuts"], F.array(at.cast("long") * (size + 1) + n)))
                return F.when(at < whole, _let(kept, told)).otherwise(state)

            return _let(onward(state), go)

        def block(state: Column, _: Column) -> Column:
            ended = (state["kept"] >= 0) & (state["at"] + state["kept"] >= whole)
            whole_list = lambda t: _state(t["at"], t["kept"], F.concat(state["cuts"], t["cuts"]))
            return F.when(ended, state).otherwise(F.aggregate(steps, _state(state["at"], state["kept"], none), grow, whole_list))

        def blocks(state: Column, _: Column) -> Column:
            ended = (state["kept"] >= 0) & (state["at"] + state["kept"] >= whole)
            return F.when(ended, state).otherwise(F.aggregate(steps, state, block))

        none = F.array().cast("array<bigint>")
        steps = F.sequence(F.lit(1), F.lit(BLOCK))
        # As many steps as the smallest one may need; one look at 65,536 of them tells that the text has ended.
        many = F.sequence(F.lit(0), F.floor(whole / (least * BLOCK * BLOCK)).cast("int") + 1)
        cuts = F.aggregate(many, _state(F.lit(0), F.lit(-1), none), blocks, lambda s: s["cuts"])
        length = lambda c: (c % (size + 1)).cast("int")
        start = lambda c: F.floor(c / (size + 1)).cast("int")
        pieces = F.transform(cuts, lambda c: F.btrim(F.substring(window(start(c)), F.lit(1), length(c))))
        return F.when(whole > 0, F.filter(pieces, lambda p: p != "")).otherwise(F.array().cast("array<string>"))

    clean = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    segments = lambda c: F.regexp_extract_all(c, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return _let(clean, lambda c: _let(F.struct(F.length(c).alias("whole"), segments(c).alias("segments")), cut))


def language(text: Column) -> Column:
    """T4: uz-cyrl, ru, uz-latn, en or NULL.

    Words are split once and compared with both marker lists, instead of one pattern per marker.
    """
    lowered = F.lower(text)
    words = F.split(lowered, r"[^\p{L}\p{N}_]+")

    def hits(markers: tuple[str, ...]) -> Column:
        plain = [m for m in markers if "'" not in m]
        total = F.size(F.filter(words, lambda w: w.isin(*plain)))
        for marker in markers:
            if "'" in marker:
                total = total + F.regexp_count(lowered, F.lit(rf"(?U)\b{marker}\b"))
        return total

    uz = hits(K.UZ_MARKERS) + F.regexp_count(text, F.lit("o'|O'|G'|g'"))
    en = hits(K.EN_MARKERS)
    latin = F.when(uz > en, "uz-latn").when(en > uz, "en")
    return (
        F.when(text.rlike("[а-яёА-ЯЁ]"), F.when(text.rlike("[ЎўҚқҒғҲҳ]"), "uz-cyrl").otherwise("ru"))
        .when(text.rlike("[A-Za-z]"), latin)
    )


def answer_language(last_message: Column, requested: Column) -> Column:
    """The detected language of a message goes before the requested one; unknown ones count as none."""
    target = F.coalesce(language(last_message), requested)
    return F.when(target.isin(*K.LANGUAGE_NAMES), target)


def mask_secrets(text: Column, literals: tuple[str, ...] = ()) -> Column:
    """T5: three patterns in order, then literal secrets of six or more characters."""
    for pattern, replacement in K.SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, replacement)
    for literal in literals:
        if len(literal) >= K.MIN_LITERAL_SECRET:
            text = F.replace(text, F.lit(literal), F.lit("***"))
    return text
