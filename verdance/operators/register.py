"""The ladder of registration attempts over series of images, with the moves of earlier images as a hint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.operators.ordering import beside, numbered
from verdance.sources.writers import resumed

C = F.col

#: Residuals in metres that attempts may leave, the last one for the final attempt alone; and the least brightness difference that is matched.
LIMITS, LAST_LIMIT, TONE = (2.0, 5.0, 10.0), 15.0, 30.0
#: Rows a block of the rolling mean.
BLOCK = 100_000


def moved(images: DataFrame, by: str, order: str, last: int = 10, least: int = 3) -> DataFrame:
    """``images`` with ``_hint``: the mean move of the last ``last`` rows in front that have ``_move``; null below ``least``.

    Rows with a move are numbered over all series and averaged in blocks, into which the rows before a block are
    copied; the mean after a row then comes to all rows behind it, so neither step needs a series in one task.
    """
    own = numbered(images.filter("_move is not null").select(by, order, "_move"), [by, order], "_i").withColumn("_block", F.floor(C("_i") / BLOCK))
    both = own.withColumn("_own", F.lit(True)).unionByName(own.filter(C("_i") % BLOCK >= BLOCK - last + 1).withColumns({"_block": C("_block") + 1, "_own": F.lit(False)}))
    w = Window.partitionBy("_block", by).orderBy("_i").rowsBetween(1 - last, 0)
    mean = F.when(F.count("_move").over(w) >= least, F.struct(F.avg("_move.dx").over(w).alias("dx"), F.avg("_move.dy").over(w).alias("dy")))
    means = both.withColumn("_mean", mean).filter("_own").select(by, order, "_mean")
    line = images.withColumns({"_mean": F.lit(None).cast(means.schema["_mean"].dataType), "_own": F.lit(True)})
    line = line.unionByName(means.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    # An image's own mean stands behind it.
    line = line.withColumn("_after", (~C("_own")).cast("int"))
    return beside(line, [by], [order, "_after"], "_mean").filter("_own").select(*images.columns, C("_p").alias("_hint"))


def ladder(images: DataFrame, by: str, order: str, left: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(by, order, method, limit, residual, dx, dy): the first attempt that succeeds for each image, in the order of each series.

    Images have ``rms`` (what a direct attempt leaves; null: it cannot be done), ``dx dy`` (the move it finds; null: not
    measured), ``tone`` (brightness difference to the reference; null: unknown, so it is matched) and ``hist_rms`` (what
    is left after matching). In turn: directly; moved beforehand by the mean of the last ten direct moves in front, if
    there are three; and last, within the widest limit, as it is or (by ``tone``) with matched brightness. ``limit`` is the
    narrowest that holds. ``left(dx, dy)`` gives what an attempt leaves after a move beforehand; by default the distance
    between that move and the image's own. ``dx dy`` of the result are the move beforehand. An image no attempt serves is
    ``failed``. Only direct attempts tell later images of their moves, so no image waits for the result of a hint.
    Order keys are unique in a series; images without one are left out.
    """
    left = left or (lambda dx, dy: F.hypot(C("dx") - dx, C("dy") - dy))
    most = LIMITS[-1]
    own = images.filter(C(order).isNotNull()).withColumn("_move", F.when((C("rms") <= most) & C("dx").isNotNull() & C("dy").isNotNull(), F.struct("dx", "dy")))
    rows = moved(own, by, order).withColumn("_left", F.when(C("_hint").isNotNull(), left(C("_hint.dx"), C("_hint.dy"))))
    alike = F.coalesce(C("tone") <= TONE, F.lit(False))
    method = F.when(C("rms") <= most, "direct").when(C("_left") <= most, "offset").when(alike & (C("rms") <= LAST_LIMIT), "relaxed").when(~alike & (C("hist_rms") <= LAST_LIMIT), "hist").otherwise("failed")
    rows = rows.withColumn("method", method)
    is_ = lambda *names: C("method").isin(*names)
    rows = rows.withColumn("residual", F.when(is_("direct", "relaxed"), C("rms")).when(is_("offset"), C("_left")).when(is_("hist"), C("hist_rms")))
    limit = F.coalesce(*(F.when(C("residual") <= x, F.lit(x)) for x in (*LIMITS, LAST_LIMIT)))
    return rows.select(by, order, "method", limit.alias("limit"), "residual", F.when(is_("offset"), C("_hint.dx")).alias("dx"), F.when(is_("offset"), C("_hint.dy")).alias("dy"))


def registered(images: DataFrame, by: str, order: str, path: str) -> DataFrame:
    """The log at ``path`` after the ladder was run for all images it does not hold; it holds successes, so failed images are tried again.

    As moves are not read from the log, a resumed series starts without a hint.
    """
    return resumed(images.filter(C(order).isNotNull()), path, [by, order], lambda rest: ladder(rest, by, order).filter("method <> 'failed'"))
