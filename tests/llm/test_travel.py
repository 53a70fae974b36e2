import subprocess
import sys

from pyspark import cloudpickle

from quernel.llm import batchdedup, conversations, packing, residue, sentences, splitting, tokens


def test_functions_need_no_package_in_workers(tmp_path):
    work = (tokens.count_tokens, tokens.cut_tokens, sentences.sentence_spans, residue.message_class, batchdedup.page_key, packing.fill, splitting.range_pieces, conversations._payload)
    (tmp_path / "f").write_bytes(cloudpickle.dumps(work))
    code = "import pickle, sys; fs = pickle.load(open(sys.argv[1], 'rb')); assert fs[2]('A b. C d.') == [(0, 4), (5, 9)]; fs[0]('x'); assert 'quernel' not in sys.modules"
    subprocess.run([sys.executable, "-I", "-c", code, str(tmp_path / "f")], check=True, cwd=tmp_path)
