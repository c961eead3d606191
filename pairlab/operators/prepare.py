"""PREP: prompt, chat and token datasets for fine-tuning and sampling."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.numeric import safe_divide
from pairlab.functions.text import TOKEN_PATTERN, fill_template, seeded_hash
from pairlab.operators.scan import dense_index, keep_first
from pairlab.operators.texts import encode_ids

# The four prompt templates (prompt text and response marker).
TEMPLATES = {
    "code_opt": (
        "Below is a program. Optimize the program and provide a more efficient version.\n\n### Program:\n{src_code}\n\n### Optimized Version:\n",
        "### Optimized Version:"),
    "code_opt_w_speedup_bin": (
        "Below is a program. Optimize the program and provide a more efficient version with at least {speedup_bin} speedup.\n\n### Program:\n{src_code}\n\n### Optimized Version with at least {speedup_bin}:\n",
        "### Optimized Version:"),
    "code_opt_w_speedup_desc": (
        "Below is a program. Optimize the program and provide a {speedup_desc} version.\n\n### Program:\n{src_code}\n\n### {speedup_desc} optimized Version:\n",
        "### Optimized Version:"),
    "code_opt_w_speedup_pctile": (
        "This is a slow program we want to optimize {pctile}/10. ### Program:\n{src_code}\n\n### Optimized Version with score {pctile}/10:\n",
        "### Optimized Version:"),
}

# Chat framing (system message and user message template).
CHAT_SYSTEM = "You are a helpful assistant that can optimize code."
CHAT_USER_TEMPLATE = "// slower version::\n\n{src_code}\n\n// optimized version of the same code:\n\n"

_SLOT = re.compile(r"\{(\w+)\}")


def _present(c: Column | None) -> Column:
    if c is None:
        return F.lit(False)
    return c.isNotNull() & (c != F.lit(""))


def training_prompt(df: DataFrame, template: str = "code_opt", *, cutoff: int = 1500,
                    target: bool = True, src: str = "src_code", tgt: str = "tgt_code",
                    speedup_desc: str | None = None, speedup_bin: str | None = None,
                    pctile: str | None = None, pctile_test: bool = False,
                    out: str = "prompt") -> DataFrame:
    """the training prompt of each pair.

    Slot precedence: description > bin > percentile > "10" at test time >
    program only; an empty string counts as absent.  Setting description and
    bin together, or choosing a slot the template cannot take while it needs
    another, raises at run time.  Programs are cut to ``cutoff`` characters
    and the (cut) target is appended when present.
    """
    text = TEMPLATES[template][0] if template in TEMPLATES else template
    needed = set(_SLOT.findall(text))
    s = F.substring(F.col(src), 1, cutoff)
    cols = {"speedup_desc": F.col(speedup_desc) if speedup_desc else None,
            "speedup_bin": F.col(speedup_bin) if speedup_bin else None,
            "pctile": F.col(pctile) if pctile else None}

    def branch(slot: str | None, value: Column | None) -> Column:
        given = {"src_code"} | ({slot} if slot else set())
        if not needed <= given:
            missing = ", ".join(sorted(needed - given))
            return F.raise_error(F.lit(f"template slot(s) {missing} not provided")).cast("string")
        return fill_template(text, {"src_code": s, **({slot: value} if slot else {})})

    chain = F.when(_present(cols["speedup_desc"]) & _present(cols["speedup_bin"]),
                   F.raise_error(F.lit("a pair may carry a speedup description or a speedup bin, not both")).cast("string"))
    chain = chain.when(_present(cols["speedup_desc"]), branch("speedup_desc", cols["speedup_desc"]))
    chain = chain.when(_present(cols["speedup_bin"]), branch("speedup_bin", cols["speedup_bin"]))
    chain = chain.when(_present(cols["pctile"]), branch("pctile", cols["pctile"]))
    res = chain.otherwise(branch("pctile", F.lit("10")) if pctile_test else branch(None, None))
    if target:
        t = F.substring(F.col(tgt), 1, cutoff)
        res = F.when(_present(F.col(tgt)), F.concat(res, t)).otherwise(res)
    return df.withColumn(out, res)


def chat_examples(df: DataFrame, *, src: str = "src_code", tgt: str = "tgt_code",
                  system: str = CHAT_SYSTEM, max_len: int = -1) -> DataFrame:
    """three-message chat example per pair (target cut to ``max_len``
    characters when positive), plus its JSON line."""
    t = F.col(tgt) if max_len <= 0 else F.substring(F.col(tgt), 1, max_len)
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"),
                 fill_template(CHAT_USER_TEMPLATE, {"src_code": F.col(src)}).alias("content")),
        F.struct(F.lit("assistant").alias("role"), t.alias("content")))
    return df.withColumn("messages", msgs).withColumn(
        "json", F.to_json(F.struct(F.col("messages").alias("messages"))))


def hashed_token_ids(text: Column, vocab: int = 32000, offset: int = 3) -> Column:
    """Default tokenizer: regex tokens mapped to ids by hash (ids < offset are
    reserved: 0 pad/unk, 1 bos, 2 eos).  JVM-side, no vocabulary file."""
    toks = F.regexp_extract_all(text, F.lit(f"({TOKEN_PATTERN})"), 1)
    return F.transform(toks, lambda t: (F.pmod(F.xxhash64(t), F.lit(vocab - offset)) + offset).cast("int"))


def md5_token_ids(text: Column, vocab: int = 32000, offset: int = 3) -> Column:
    """The same with ids from MD5, which any SQL engine can repeat."""
    toks = F.regexp_extract_all(text, F.lit(f"({TOKEN_PATTERN})"), 1)
    number = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint")
    return F.transform(toks, lambda t: (number(t) % F.lit(vocab - offset) + offset).cast("int"))


def tokenize_and_mask(df: DataFrame, *, full: str = "full_prompt", user: str = "user_prompt",
                      cutoff: int = 512, train_on_inputs: bool = False, add_eos: bool = True,
                      eos_id: int = 2, tokenizer=None, token_ids: Callable[[Column], Column] = hashed_token_ids) -> DataFrame:
    """input_ids, attention_mask and labels; prompt tokens masked with -100.

    Cut at ``cutoff``; EOS appended only when the cut sequence is shorter and
    does not already end in EOS.  The mask covers the user prompt's token count
    minus one when EOS is requested (even if none was added).  Ids come from the
    column function ``token_ids``, or from ``tokenizer`` (a ``SubwordTokenizer`` or a
    callable of one text), which encodes every distinct text once; a NULL text has
    no ids.
    """
    if tokenizer is None:
        enc = lambda c: token_ids(F.col(c))
    else:
        df = encode_ids(df, full, tokenizer, out="_ids_full").rows
        df = encode_ids(df, user, tokenizer, out="_ids_user").rows if not train_on_inputs else df
        enc = lambda c: F.coalesce(F.col("_ids_full" if c == full else "_ids_user"), F.array().cast("array<int>"))

    def tok(c: str, eos: bool) -> Column:
        ids = F.slice(enc(c), 1, cutoff)
        if not eos:
            return ids
        last = F.try_element_at(ids, F.lit(-1))
        need = (F.size(ids) < cutoff) & F.coalesce(last != F.lit(eos_id), F.lit(True))
        return F.when(need, F.array_append(ids, F.lit(eos_id))).otherwise(ids)

    d = df.withColumn("input_ids", tok(full, True))
    d = d.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    if train_on_inputs:
        return d.withColumn("labels", F.col("input_ids")).drop("_ids_full")
    n_user = F.size(tok(user, add_eos)) - (1 if add_eos else 0)
    d = d.withColumn("_n", F.greatest(n_user, F.lit(0)))
    labels = F.concat(F.array_repeat(F.lit(-100), F.col("_n")),
                      F.slice(F.col("input_ids"), F.col("_n") + 1, F.lit(1 << 30)))
    return d.withColumn("labels", labels).drop("_n", "_ids_full", "_ids_user")


def shuffle_head(df: DataFrame, n: int = -1, *, key: str, seed: int) -> DataFrame:
    """O2: seeded shuffle by a hash of seed and key (any type), then the first n rows (-1 = all rows)."""
    d = df.orderBy(seeded_hash(F.col(key), seed=seed), F.col(key))
    return d if n < 0 else d.limit(n)


def first_n(df: DataFrame, n: int, *, ordinal: str) -> DataFrame:
    """O1: first n rows in ``ordinal`` order (-1 = all)."""
    return df if n < 0 else df.orderBy(ordinal).limit(n)


def performance_tag(subs: DataFrame, *, group: str = "problem_id", runtime: str = "agg_runtime",
                    bins: int = 10, out: str = "pctile", method: str = "ratio",
                    order_key: str | None = None) -> DataFrame:
    """1..bins tag of how close a submission is to the best of its problem.

    ``ratio``: max(1, ceil(bins * best / runtime)), ``bins`` for a runtime of 0.  ``ntile``: SQL NTILE(bins)
    over the problem's submissions from slowest (1) to fastest (bins), ties by
    ``order_key``.  The ntile positions come from one global range-partitioned
    numbering (a hot problem is split across partitions) minus each problem's
    first position; no per-problem window.  The tag is a string slot value.
    """
    if method == "ratio":
        best = subs.groupBy(group).agg(F.min(runtime).alias("_best"))
        # a runtime of 0 is the best there is
        score = F.when(F.col(runtime) == 0, F.lit(1.0)).otherwise(safe_divide(F.col("_best"), F.col(runtime)))
        return (subs.join(best, group)
                .withColumn(out, F.greatest(F.lit(1), F.ceil(F.lit(float(bins)) * score)).cast("string"))
                .drop("_best"))
    if method != "ntile":
        raise ValueError(method)
    if order_key is None:
        raise ValueError("ntile needs order_key for a total order")
    d = subs.withColumn("_neg", -F.col(runtime))
    d = dense_index(d, [group, "_neg", order_key], name="_pos")
    first = d.groupBy(group).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_n"))
    first = first.withColumnRenamed(group, "_g")
    d = d.join(first, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").withColumn("_i", F.col("_pos") - F.col("_start"))
    q = F.floor(F.col("_n") / bins)
    r = F.col("_n") - q * bins
    big = r * (q + 1)
    bucket = F.when(F.col("_i") < big, F.floor(F.col("_i") / (q + 1)) + 1).otherwise(
        r + F.floor((F.col("_i") - big) / q) + 1)
    return d.withColumn(out, bucket.cast("long").cast("string")).drop("_neg", "_pos", "_start", "_n", "_i")


def latest_metrics(metrics: DataFrame, *, file: str = "file", step: str = "step") -> DataFrame:
    """The last row (highest step) of every metrics file."""
    return keep_first(metrics, [file], [-F.col(step)])


def build_training_set(pairs: DataFrame, *, form: str = "prompt", template: str = "code_opt",
                       seed: int = 0, n: int = -1, key: str = "src_id", **kw) -> DataFrame:
    """Composed PREP job: seeded shuffle (O2), then prompts (F7), chats
    or token rows (F11)."""
    d = shuffle_head(pairs, n, key=key, seed=seed)
    if form == "prompt":
        return training_prompt(d, template, **kw)
    if form == "chat":
        return chat_examples(d, **kw)
    if form == "tokens":
        d = training_prompt(d, template, out="full_prompt")
        d = training_prompt(d, template, target=False, out="user_prompt")
        return tokenize_and_mask(d, **kw)
    raise ValueError(form)
