"""The feature pipeline end to end, in the order the model expects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelkit.operators import features as FE
from panelkit.operators.rolling import Keys, _keys
from panelkit.plans import scan
from panelkit.plans.written import written, written_together

LOG_TARGET = "log_market_forward_excess_returns"
DERIVED_PREFIXES = ("MOM_", "VI_")


def base_features(columns: Sequence[str], excluded: Sequence[str], keys: Sequence[str],
                  prefixes: Sequence[str] = DERIVED_PREFIXES) -> list[str]:
    """Columns that P4 extends: no key, no excluded one, none with a derived prefix."""
    return [c for c in columns if c not in excluded and c not in keys and not c.startswith(tuple(prefixes))]


def panel_pipeline(df: DataFrame, arith: str = "market_forward_excess_returns", keys: Keys = "series_id",
                   order: str = "t", start: str = "1990-01-01", impute_first: bool = False,
                   extend: Sequence[str] | None = None, stats: Sequence[str] | None = None,
                   fill: float = FE.SENTINEL, first_fill: float = FE.SENTINEL,
                   block_rows: int = scan.DEFAULT_BLOCK_ROWS, together: bool = False) -> DataFrame:
    """Calendar (P7), log target (B10), momentum (P1), volatility (P2), missing
    flags and fill (P3), extension (P4) and guards (P5) of a raw panel.

    ``extend`` names the features that P4 extends (all base features by
    default; ``MOM_`` and ``VI_`` columns never are), ``stats`` the statistics
    of P4 to keep (all by default).  With ``impute_first`` missing values are
    filled before the extension sees them, otherwise after it.  The position
    of a row in its series gives its date.  ``together`` says that the rows of a series
    are in one partition of ``df``, as a window over the series leaves them.
    """
    ks = [*_keys(keys), order]
    # only the raw rows are written, in buckets of series; the wide columns are worked out again for the guards and for
    # the output, as they would take many times the disk.  Where every series fits a block, all windows run inside the
    # buckets: nothing is exchanged after this
    buckets, raw = written_together(df, "panel-rows", _keys(keys), order, together)
    longest = scan.longest_series(raw, keys, order)
    if longest <= block_rows:
        rows = scan.row_index(buckets, keys, order, out="pk_pos", longest=longest)
    else:
        rows = raw = written(scan.row_index(raw, keys, order, out="pk_pos"), "panel-positions")
    d = FE.add_date(rows, start, "pk_pos").drop("pk_pos")
    d = FE.target_log(d, arith, LOG_TARGET)
    excluded = [*FE.EXCLUDED, arith, LOG_TARGET]
    base = [c for c in base_features(df.columns, excluded, ks) if extend is None or c in extend]
    d = FE.momentum_volatility(d, LOG_TARGET, keys, order, fill, first_fill, block_rows, longest, extend=base,
                               extend_fill=fill if impute_first else None)
    kept = list(stats) if stats is not None else FE.extension_names()
    extended = [f"{c}_{s}" for c in base for s in kept]
    d = d.drop(*[f"{c}_{s}" for c in base for s in FE.extension_names() if s not in kept])
    filled, _ = FE.impute(d, fill, [*excluded, *extended], ks, counted=raw)
    filled = filled.select(*[c for c in filled.columns if c not in extended], *extended)
    return FE.guard_wide(filled, fill, excluded, ks)
