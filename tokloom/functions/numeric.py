"""Column expressions for the training-side formulas: schedule, parameter
counts, perplexity, deterministic uniforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (COSINE_END_FACTOR, FFN_MULTIPLE, PERPLEXITY_CLAMP,
                        WARMUP_START_FACTOR)


def _c(c) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(c)


def lr_at(step, lr, warmup, max_steps) -> Column:
    """Learning rate at ``step``: linear 0.02*lr -> lr over ``warmup`` steps, then
    cosine lr -> 0.1*lr over ``max_steps - warmup`` steps (held at the end)."""
    step, lr, warmup, max_steps = _c(step), _c(lr), _c(warmup), _c(max_steps)
    init = lr * WARMUP_START_FACTOR
    linear = init + (lr - init) * F.least(step, warmup) / warmup
    decay_steps = max_steps - warmup
    s = F.least(step - warmup, decay_steps)
    end = lr * COSINE_END_FACTOR
    cosine = end + 0.5 * (1 + F.cos(F.lit(math.pi) / decay_steps * s)) * (lr - end)
    return F.when(step < warmup, linear).otherwise(cosine)


def ffn_hidden(n_embd) -> Column:
    """SwiGLU width: int(8C/3) rounded up to a multiple of 64."""
    h = F.floor(_c(n_embd) * 8 / 3)
    return (F.ceil(h / FFN_MULTIPLE) * FFN_MULTIPLE).cast("bigint")


def model_params(vocab, n_layers, n_embd) -> Column:
    """Parameter count with tied input/output embedding:
    V*C + L*(4*C^2 + 3*C*H + 2*C) + C."""
    v, l, c = _c(vocab).cast("bigint"), _c(n_layers).cast("bigint"), _c(n_embd).cast("bigint")
    h = ffn_hidden(c)
    return v * c + l * (4 * c * c + 3 * c * h + 2 * c) + c


def embed_params(vocab, n_embd) -> Column:
    return _c(vocab).cast("bigint") * _c(n_embd).cast("bigint")


def perplexity(loss, clamp: bool = True) -> Column:
    """exp(min(loss, 20)) as in the progress line; ``clamp=False`` is exp(loss)."""
    return F.exp(F.least(_c(loss), F.lit(PERPLEXITY_CLAMP))) if clamp else F.exp(_c(loss))


def md5_uniform(seed, *keys) -> Column:
    """Deterministic uniform in [0, 1) from md5 of ``seed|key...``.

    Independent of partitioning (unlike ``rand``): 52 bits of the digest.
    """
    parts = [F.lit(str(seed))] + [_c(k).cast("string") for k in keys]
    h = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(h, 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))
