import random

import numpy as np

from strandline.llm import audio


def texts():
    rng = random.Random(2)
    return [None, "", "a"] + ["".join(rng.choices("ab \néz", k=n)) for n in (63, 64, 700, 5000, 5461, 5462, 70000)]


def test_features_come_from_stored_tensors(spark, folder, monkeypatch):
    rows = list(enumerate(texts()))
    sf = folder(documents=rows)
    got = {r.doc_id: r for r in audio.op6_audio(spark, sf).collect()}
    kept = {r.doc_id: r for r in audio.stored(audio.table(spark, sf, "documents")).collect()}
    a = audio.Analyser()
    for i, t in rows:
        mel, energy = a.log_mel(audio.resample(audio.payload((t or "").encode())))
        start, stop, values = audio.from_ipc(bytes(kept[i].tensors))
        assert values.dtype == np.float32 and values.shape == (-(-len(mel) // audio.FRAMES), audio.FRAMES, audio.BANDS)
        assert [(x, z) for x, z, _ in a.tensors(mel)] == list(zip(start, stop))
        assert np.array_equal(audio.joined(*audio.from_ipc(audio.to_ipc(list(a.tensors(mel))))), mel)
        back = audio.joined(start, stop, values)
        assert back.shape == mel.shape and np.allclose(back, mel, atol=1e-4)  # sums in another process may round otherwise
        assert got[i].feature == audio.digest(back, [tuple(s) for s in kept[i].segments])
    calls = []
    monkeypatch.setattr(audio, "stored", lambda docs, of=audio.stored: calls.append(1) or of(docs))
    audio.op6_audio(spark, sf)
    assert calls == [1]
