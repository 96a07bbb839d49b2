"""Column functions of names, ids, paths, URLs, keys and times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of a pass cycle and its first day.
PASS_DAYS = 6
PASS_EPOCH = "2014-01-01"


def pass_id(acq_dt: Column) -> Column:
    """Whole six-day cycles since the epoch."""
    return F.floor(F.timestamp_diff("SECOND", F.lit(PASS_EPOCH).cast("timestamp_ntz"), acq_dt) / (86400 * PASS_DAYS))


def polarization_name(pols: Column) -> Column:
    """VV+VH or HH+HV where both of a pair are in the list, else the list joined."""
    has = lambda *p: F.array_contains(pols, p[0]) & F.array_contains(pols, p[1])
    return F.when(has("VV", "VH"), "VV+VH").when(has("HH", "HV"), "HH+HV").otherwise(F.array_join(pols, "+"))


def burst_key(id_: Column) -> Column:
    return F.upper(F.translate(id_, "-", "_"))


def utm_epsg(tile: Column) -> Column:
    """326zz north and 327zz south of the equator, from a tile's zone and band; an error outside zones 1 to 60."""
    zone = F.nullif(F.regexp_extract(tile, r"^(\d{1,2})([C-HJ-NP-X])", 1), F.lit("")).cast("int")
    band = F.regexp_extract(tile, r"^(\d{1,2})([C-HJ-NP-X])", 2)
    wrong = F.raise_error(F.concat(F.lit("not a tile name: "), tile)).cast("int")
    return F.when(zone.between(1, 60), F.when(band < "N", 32700 + zone).otherwise(32600 + zone)).otherwise(wrong)


def subswath(burst: Column) -> Column:
    """(IWn, last whole number in the id): name and place of a burst inside its swath."""
    parts = F.split(F.upper(F.translate(burst, "_", "-")), "-")
    swath = F.element_at(F.filter(parts, lambda p: p.rlike("^IW[0-9]$")), 1)
    number = F.element_at(F.filter(parts, lambda p: p.rlike("^[0-9]+$")), -1).cast("int")
    return F.struct(swath.alias("swath"), number.alias("number"))


def track_of_store(path: Column) -> Column:
    """The number behind _TK in the last part of a path; NULL without one."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"_TK(\d+)", 1), F.lit(""))


def store_token(path: Column) -> Column:
    """Token, first track and burst number of names like x_TK12-18_N4."""
    token = F.nullif(F.regexp_extract(path, r"TK([\d-]+)", 1), F.lit(""))
    return F.struct(token.alias("token"), F.element_at(F.split(token, "-"), 1).cast("int").alias("track"), F.nullif(F.regexp_extract(path, r"_N(\d+)", 1), F.lit("")).cast("int").alias("n_bursts"))


def month_in_name(path: Column) -> Column:
    """The first yyyy-mm, yyyy_mm or yyyymm of a name, as yyyy-MM."""
    y, m = (F.regexp_extract(path, r"(?<!\d)((?:19|20)\d{2})[-_]?(0[1-9]|1[0-2])(?!\d)", k) for k in (1, 2))
    return F.when(y != "", F.concat_ws("-", y, m))


def tile_in_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?<![A-Z0-9])(\d{2}[C-HJ-NP-X][A-HJ-NP-Z]{2})(?![A-Z0-9])", 1), F.lit(""))


def tile_sort_key(tile: Column) -> Column:
    """Zone, then the letters as digits of base 100."""
    digit = lambda k: F.ascii(F.substr(tile, F.lit(k), F.lit(1)))
    return F.struct(F.substr(tile, F.lit(1), F.lit(2)).cast("int").alias("zone"), (digit(3) * 10000 + digit(4) * 100 + digit(5)).alias("letters"))


def python_float(v: Column) -> Column:
    """A double as Python prints it for ordinary sizes: at least one decimal place."""
    text = F.format_string("%.9f", v)
    short = F.regexp_replace(text, r"0+$", "")
    return F.when(short.endswith("."), F.concat(short, F.lit("0"))).otherwise(short)


def grid_id(tile: Column, crs: Column, transform: Column, width: Column, height: Column, resolution: Column, version: Column) -> Column:
    """Twelve hexadecimal digits of the SHA-256 of the grid as compact JSON with sorted keys and rounded numbers."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    steps = F.array_join(F.transform(transform, lambda x: python_float(F.round(x, 9))), ",")
    doc = F.concat(F.lit('{"crs":'), q(crs), F.lit(',"h":'), height.cast("string"), F.lit(',"res":'), python_float(resolution), F.lit(',"tile":'), q(tile), F.lit(',"transform":['), steps, F.lit('],"v":'), version.cast("string"), F.lit(',"w":'), width.cast("string"), F.lit("}"))
    return F.substr(F.sha2(doc, 256), F.lit(1), F.lit(12))


def processing_signature(values: dict[str, Column]) -> Column:
    """p and eleven hexadecimal digits of the SHA-256 of sorted, compact JSON."""
    doc = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":"'), values[k], F.lit('"')) for k in sorted(values)]), F.lit("}"))
    return F.concat(F.lit("p"), F.substr(F.sha2(doc, 256), F.lit(1), F.lit(11)))


def variant_name(parts: Sequence[tuple[Column, Column]]) -> Column:
    """Parts whose condition holds, joined by _."""
    return F.concat_ws("_", *[F.when(on, text) for on, text in parts])


def rebase_path(path: Column, prefix: str) -> Column:
    """prefix/path with forward slashes, once."""
    clean = F.ltrim(F.translate(path, "\\", "/"), F.lit("/"))
    return F.when(clean.startswith(prefix + "/") | (clean == ""), clean).otherwise(F.concat(F.lit(prefix + "/"), clean))


def layer_urls(url: Column, layers: Sequence[str]) -> Column:
    """URLs of a scene's other layers, by its suffix."""
    stem = F.regexp_replace(url, r"_(VV|VH|HH|HV)\.tif$", "")
    return F.array(*[F.concat(stem, F.lit(f"_{name}.tif")) for name in layers])


#: Query keys that carry credentials.
CREDENTIAL_KEYS = ("access_token", "token", "id_token", "refresh_token", "auth", "authorization", "signature", "sig", "password", "secret", "client_secret", "api_key", "apikey", "awsaccesskeyid", "googleaccessid", "credential", "credentials")
CREDENTIAL_PREFIXES = ("x-amz-", "x-goog-")
#: Keys of a signed URL that go with its signature `sig`.
SIGNED_KEYS = ("sv", "ss", "srt", "sp", "se", "st", "spr", "sr", "sip", "skoid", "sktid", "skt", "ske", "sks", "skv", "saoid", "suoid", "scid")


def sanitised_url(url: Column) -> Column:
    """Without credential keys in the query, the others in order; NULL with user info, a scheme that is not http, https or
    s3, or credentials behind the hash mark."""
    bare, anchor = F.element_at(F.split(url, "#", 2), 1), F.try_element_at(F.split(url, "#", 2), F.lit(2))
    head, query = F.element_at(F.split(bare, r"\?", 2), 1), F.try_element_at(F.split(bare, r"\?", 2), F.lit(2))
    pairs = F.split(F.coalesce(query, F.lit("")), "&")
    key = lambda p: F.lower(F.coalesce(F.try_url_decode(F.element_at(F.split(p, "="), 1)), p))
    secret = lambda k: k.isin(*CREDENTIAL_KEYS) | k.rlike("^(" + "|".join(CREDENTIAL_PREFIXES) + ")")
    signed = F.exists(pairs, lambda p: key(p) == "sig")
    kept = F.filter(pairs, lambda p: (p != "") & ~secret(key(p)) & ~(signed & key(p).isin(*SIGNED_KEYS)))
    fine = F.lower(head).rlike("^(https?|s3)://") & ~head.rlike("^[^/]*//[^/]*@") & ~F.coalesce(F.exists(F.split(anchor, "&"), lambda p: key(p).isin(*CREDENTIAL_KEYS)), F.lit(False))
    return F.when(fine, F.concat(head, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), F.coalesce(F.concat(F.lit("#"), anchor), F.lit(""))))


def local_path(url: Column, *folders: Column) -> Column:
    """Folders and the URL's file name; a folder with a separator, a dot or a blank is an error."""
    bad = F.lit(False)
    for f in folders:
        bad = bad | f.rlike(r"[/\\.\s]")
    path = F.concat_ws("/", *folders, F.element_at(F.split(url, "/"), -1))
    return F.when(bad, F.raise_error(F.lit("a folder name holds a separator")).cast("string")).otherwise(path)


def months_of(start: Column, end: Column) -> Column:
    """First days of the months from start to end."""
    return F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))


def split_by_year(start: Column, end: Column) -> Column:
    """The parts of start..end, one a calendar year."""
    years = F.sequence(F.year(start), F.year(end))
    return F.transform(years, lambda y: F.struct(F.greatest(start, F.make_date(y, F.lit(1), F.lit(1))).alias("a"), F.least(end, F.make_date(y, F.lit(12), F.lit(31))).alias("b")))


def period_key(t: Column, strategy: str) -> Column:
    """Bucket of a time by yearly, quarterly or monthly batches."""
    unit = {"yearly": "year", "quarterly": "quarter", "monthly": "month"}[strategy]
    return F.date_format(F.date_trunc(unit, t), "yyyy-MM")


def demand_gb(scenes: Column, rows: int, cols: int, blockwise: bool = True, safety: float = 1.5) -> Column:
    """Memory that a batch of two-band float32 scenes needs; blockwise work holds a quarter."""
    plane = rows * cols * 4 / 1024**3
    return scenes * (2 * plane * (0.25 if blockwise else 1.0) * safety)


def batch_strategy(yearly: Column, quarterly: Column, monthly: Column, memory_gb: float) -> Column:
    """The longest batch whose demand fits in 80 % of memory."""
    fits = lambda d: d <= 0.8 * memory_gb
    return F.when(fits(yearly), "yearly").when(fits(quarterly), "quarterly").otherwise("monthly")


def plan_gib(bands: Column, steps: Column, tiles: Column, directions: Column, resolution: int = 30) -> Column:
    return (109800 / resolution) ** 2 * bands * 4 * steps * tiles * directions / 1024**3


def utm_to_lonlat(easting: Column, northing: Column, zone: Column, south: Column) -> Column:
    """Inverse UTM on WGS84 by the series for the footpoint latitude, as column arithmetic."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    x, y = easting - 500000.0, northing - F.when(south, 10000000.0).otherwise(0.0)
    mu = y / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    p1 = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
    s, c, t = F.sin(p1), F.cos(p1), F.tan(p1)
    n, r = a / F.sqrt(1 - e2 * s * s), a * (1 - e2) / F.pow(1 - e2 * s * s, F.lit(1.5))
    t2, c2, d = t * t, ep2 * c * c, x / (n * k0)
    lat = p1 - n * t / r * (d * d / 2 - (5 + 3 * t2 + 10 * c2 - 4 * c2 * c2 - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t2 + 298 * c2 + 45 * t2 * t2 - 252 * ep2 - 3 * c2 * c2) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t2 + c2) * F.pow(d, 3) / 6 + (5 - 2 * c2 + 28 * t2 - 3 * c2 * c2 + 8 * ep2 + 24 * t2 * t2) * F.pow(d, 5) / 120) / c
    return F.struct((F.degrees(lon) + zone * 6 - 183).alias("lon"), F.degrees(lat).alias("lat"))
