import hashlib
import random

from pyspark.sql import functions as F

from trustfold.llm import chat_format as c

NASTY = ["</s>", "[INST]", "[/INST]", "<|user|>", "&lt;", "&amp;amp;", "é\n\n", "", "<|", "|>", "😀"]


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for conv in range(30):
        n = rng.randrange(1, 25)
        for t in range(n):
            role = "system" if t == 0 and conv % 3 == 0 else ["user", "assistant"][t % 2]
            text = " ".join(rng.choice([*NASTY, "word", "longer"]) for _ in range(rng.randrange(0, 80))) if rng.random() > 0.05 else None
            out.append((conv, t, role, text))
    return [*out, (99, 0, "assistant", "x" * 200_000), (98, None, None, None), (98, 0, "we<ird|>", "a"), (None, 0, "user", "lost")]


def test_round_trip_and_loss(spark):
    data = rows()
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    df = df.withColumns({n: F.lit("clash") for n in ("window", "formatted", "tokens", "pos", "head")})
    windows = c.chat_windows(df, budget=300, history=60)
    got = {r.conv_id: r for r in c.chat_digests(windows).collect()}
    for conv in {r[0] for r in data}:
        turns = sorted((r for r in data if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].formatted_chars == sum(len(r.formatted) for r in windows.where(F.col("conv_id").eqNullSafe(conv)).collect())


def test_windows_keep_to_the_budget(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    for w in c.chat_windows(df, budget=300, history=60).collect():
        turns = w.formatted.split(c.END)[:-1]
        own = turns[w.n_repeated :]
        assert own and (w.n_tokens <= 300 or len(own) == 1)
        if w.n_repeated and turns[0].startswith("<|system|>"):
            assert all(not t.startswith("<|system|>") for t in turns[1:])
        assert len(w.loss_spans) == sum(t.startswith("<|assistant|>") for t in own)
        lead = len(c.END.join(turns[: w.n_repeated])) + len(c.END) * bool(w.n_repeated)
        assert all(s.start > lead for s in w.loss_spans)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert c.chat_digests(c.chat_windows(df)).first().n_turns == 2
    assert c.chat_digests(c.chat_windows(df.where("false"))).count() == 0
