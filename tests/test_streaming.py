import os
import tempfile

from lectio.streaming import start_surprisal_stream, stream_totals


def _write(d, name, rows):
    with open(os.path.join(d, name), "w") as f:
        f.write("word wlen sentpos surp\n" + "\n".join(rows) + "\n")


def test_stream_totals_accumulate_over_batches_and_restart(spark):
    src = tempfile.mkdtemp(prefix="lectio-sin-")
    out = tempfile.mkdtemp(prefix="lectio-sout-") + "/o"
    ck = tempfile.mkdtemp(prefix="lectio-sck-") + "/c"
    _write(src, "1.output-tok", ["a 1 1 1.5", "b 1 2 2.0"])
    _write(src, "2.output-tok", ["c 1 1 0.25"])
    _write(src, "2.output", ["c 1 1 99.0"])           # plain variant: not part of the sum
    start_surprisal_stream(spark, src, out, ck).awaitTermination()
    got = {r.doc_key: (r.surprisal, r.n_tokens) for r in stream_totals(spark, out).collect()}
    assert got == {"1": (3.5, 2), "2": (0.25, 1)}
    # a new article arrives; the restarted query (same checkpoint) only reads the new file
    _write(src, "3.output-tok", ["d 1 1 4.0"])
    start_surprisal_stream(spark, src, out, ck).awaitTermination()
    got = {r.doc_key: (r.surprisal, r.n_tokens) for r in stream_totals(spark, out).collect()}
    assert got == {"1": (3.5, 2), "2": (0.25, 1), "3": (4.0, 1)}
