import random
import re

from spanloom.llm import chat_format as m

SCHEMA = "conv_id bigint, turn bigint, role string, text string, prompt string"


def brute(rows):
    convs = {}
    for c, t, role, text, _ in rows:
        if c is not None and t is not None:
            convs.setdefault(c, set()).add((t, role if role is not None else "user", text or ""))
    convs = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    groups = {}
    for c, v in convs.items():
        first = next((i for i, x in enumerate(v) if x[0] == "user"), 0)
        groups.setdefault(tuple(v[: first + 1]), []).append(c)
    words = {c: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for r, t in v if r == "assistant") for c, v in convs.items()}
    out = []
    for ids in groups.values():
        best = min(ids, key=lambda c: (-words[c], c))
        if len(ids) > 1:
            out += [(c, best, c, convs[best], convs[c]) for c in ids if c != best]
        elif any(r == "assistant" for r, _ in convs[best]):
            last = max(i for i, x in enumerate(convs[best]) if x[0] == "assistant")
            out.append((best, best, None, convs[best], [*convs[best][:last], ("assistant", "")]))
    done = []
    for pair, chosen, rejected, a, b in out:
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        n = min(n, min(len(a), len(b)) - 1)
        sides = []
        for side in (a[n:], b[n:]):
            text, mask = "", []
            for role, said in side:
                text += f"<|im_start|>{role}\n"
                if role == "assistant":
                    mask.append((len(text), len(text) + len(said) + len("<|im_end|>\n")))
                text += said + "<|im_end|>\n"
            sides += [text, mask]
        done.append((pair, chosen, rejected, n, "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in a[:n]), *sides))
    return sorted(done, key=str)


def test_pairs_match_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for c in range(60):
        k = rng.randrange(8)
        talk = [("system", "be kind")] * (k % 3 == 0) + [("user", f"question é {k}")]
        for _ in range(rng.randint(0, 4)):
            talk += [(rng.choice(["assistant", "user", None]), rng.choice(["yes", "no it is", None, "", "würde"]))]
        rows += [(c, i, r, t, "x") for i, (r, t) in enumerate(talk)]
    rows += [rows[0], rows[3], (None, 1, "user", "x", None), (5, None, "user", "x", None), (900, 0, "assistant", "alone", None), (901, 0, None, None, None)]
    got = m.preference_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    have = [(r.pair_id, r.chosen_id, r.rejected_id, r.n_shared, r.prompt, r.chosen_completion, [tuple(x) for x in r.chosen_mask], r.rejected_completion, [tuple(x) for x in r.rejected_mask]) for r in got]
    assert sorted(have, key=str) == brute(rows)


def test_empty_table(spark):
    assert m.preference_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_turns_and_a_shared_opening(spark):
    long = "wörd " * 150_000
    rows = [(c, 0, "user", "hello", "x") for c in range(300)] + [(c, 1, "assistant", long if c == 7 else f"answer {c}", "x") for c in range(300)]
    got = m.preference_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 299 and all(r.chosen_id == 7 and r.n_shared == 1 and r.prompt == "<|im_start|>user\nhello<|im_end|>\n" for r in got)
    assert all(r.chosen_completion == f"<|im_start|>assistant\n{long}<|im_end|>\n" for r in got)
    assert all(r.rejected_completion[r.rejected_mask[0].lo : r.rejected_mask[0].hi] == f"answer {r.rejected_id}<|im_end|>\n" for r in got)
