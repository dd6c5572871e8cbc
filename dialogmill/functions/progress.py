"""Progress fraction and status line of a training run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialogmill.functions.text import fixed4

# The share of the whole job that training takes up.
PROGRESS_BASE = 0.3
PROGRESS_SPAN = 0.4


def progress_fraction(
    step: Column, total: int, base: float = PROGRESS_BASE, span: float = PROGRESS_SPAN
) -> Column:
    done = F.least(step.cast("double") / F.lit(float(total)), F.lit(1.0))
    return F.lit(base) + done * F.lit(span)


def status_line(step: Column, total: int, loss: Column) -> Column:
    return F.concat(
        F.lit("Step "), step.cast("string"), F.lit(f"/{total} | Loss: "), fixed4(loss)
    )


def stop_line(loss: Column, threshold: float) -> Column:
    return F.concat(F.lit("Loss "), fixed4(loss), F.lit(f" below threshold {threshold}"))


def final_line(loss: Column) -> Column:
    return F.when(loss.isNull(), "Training completed (loss not recorded)").otherwise(
        F.concat(F.lit("Training completed: Final loss "), fixed4(loss))
    )
