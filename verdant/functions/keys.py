"""Key expressions: revision keys, cache keys, public ids, path segments, UTC text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdant import constants as K


def _json_text(c: Column) -> Column:
    """A JSON scalar: quoted text with escapes, or null."""
    quoted = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def revision_key(**parts: Column) -> Column:
    """K1: first 24 hex digits of the digest of the compact JSON with sorted names."""
    pairs = [F.concat(F.lit(f'"{name}":'), _json_text(parts[name])) for name in sorted(parts)]
    body = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    return F.substring(F.sha2(body, 256), 1, 24)


def weather_key(latitude: Column, longitude: Column, start: Column, end: Column) -> Column:
    """K2: digest of the rounded position and the window."""
    return F.md5(F.concat_ws("_", F.round(latitude, 3).cast("string"), F.round(longitude, 3).cast("string"), start, end))


def public_id(seed: Column) -> Column:
    """K3: eight lowercase letters or digits, derived from the seed so that a rerun gives the same id."""
    digest = F.sha2(seed, 256)
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789"

    def letter(i: Column) -> Column:
        value = F.conv(F.substring(digest, i * 8 - 7, F.lit(8)), 16, 10).cast("long")
        return F.substring(F.lit(alphabet), (value % 36 + 1).cast("int"), F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), letter), "")


def safe_segment(text: Column) -> Column:
    """K4: a path segment of allowed characters, made unique by a digest."""
    cleaned = F.substring(F.regexp_replace(text, "[^A-Za-z0-9_.-]", "_"), 1, 48)
    return F.concat(cleaned, F.lit("-"), F.substring(F.sha2(text, 256), 1, 10))


def layer_path(field_id: Column, product: Column, revision: Column, layer: Column, values: bool = False) -> Column:
    """K4: field/product/revision/version[/values]/layer file."""
    tail = [F.lit("values"), F.concat(layer, F.lit(".npy"))] if values else [F.concat(layer, F.lit(".png"))]
    return F.concat_ws(
        "/", F.concat(F.lit("field-"), field_id.cast("string")), safe_segment(product), safe_segment(revision),
        F.lit(K.RENDER_VERSION), *tail,
    )


def utc_text(ts: Column) -> Column:
    """K5: ISO text in UTC with a Z suffix; the fraction is written only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def observation_window(ts: Column) -> tuple[Column, Column]:
    """K5: the one-second window that starts at an acquisition."""
    return utc_text(ts), utc_text(ts + F.expr("INTERVAL 1 SECOND"))
