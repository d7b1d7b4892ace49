"""Online assignment in batches against one sequential pass over all faces and people."""

import numpy as np
import pytest

from lumenark.operators import online

FACES = "image_id bigint, face_id bigint, vector array<float>, quality double, det_score double, other string"
PEOPLE = "person_id int, name string, centroid array<float>, face_count int, cover_face_id bigint"


def vectors(n, kinds, size, noise, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, size))
    return [online.unit(centres[rng.integers(kinds)] + noise * rng.normal(size=size)).astype(np.float32).tolist() for _ in range(n)], centres


def sequential(faces, people, next_id, known=()):
    """All people and faces in one loop, without shortlists."""
    kept = {}
    for _, p, v, q in sorted(known, key=lambda k: (k[1], -k[3], k[0])):
        kept.setdefault(p, []).append((q, np.asarray(v, np.float32).astype(float)))
    states = [online.PersonState(i, np.asarray(c, np.float32).astype(float), 0.6 * max(n, 1), n, f, exemplars=kept.get(i, [])[:6]) for i, _, c, n, f in people]
    a = online.Assigner(states, next_id)
    out = {}
    for image in sorted({f[0] for f in faces}):
        a.begin(image)
        for f in sorted((f for f in faces if f[0] == image), key=lambda f: (-f[3], -f[4], f[1])):
            out[f[1]] = a.decide(f[1], online.unit(np.asarray(f[2], np.float32)), f[3])
    return out, {p.person_id: p for p in a.people.values() if p.dirty}


@pytest.mark.parametrize("batch, kept, size, noise", [(40, 5, 8, 0.7), (64, 8, 24, 0.9), (4096, 8, 24, 0.9)])
def test_batches_agree_with_one_sequence(spark, batch, kept, size, noise):
    rng = np.random.default_rng(size)
    vs, centres = vectors(300, 25, size, noise, 3)
    # A third of all faces is on one image, which is cut between batches.
    faces = [(7 if i < 100 else 10 + i // 3, i, v, float(rng.choice([0.1, 0.5, 0.8, 0.9])), float(rng.random()), "x") for i, v in enumerate(vs)]
    people = [(i, f"p{i}", online.unit(c).tolist(), int(i % 4), -1) for i, c in enumerate(centres[:12])]
    known = [(1000 + i, i % 12, online.unit(centres[i % 12] + rng.normal(size=size)).tolist(), float(rng.random())) for i in range(90)]
    want, changed = sequential(faces, people, 12, known)
    stored = spark.createDataFrame(known, "face_id bigint, person_id int, vector array<float>, quality double")
    got = online.assign_states(spark.createDataFrame(faces, FACES).repartition(5), spark.createDataFrame(people, PEOPLE), stored, batch=batch, kept=kept).collect()
    assert {r.face_id: r.person_id for r in got if r.face_id is not None} == want
    assert len(set(want.values())) > 12
    states = {r.person_id: r for r in got if r.face_id is None}
    assert states.keys() == changed.keys()
    for i, p in changed.items():
        r = states[i]
        assert (r.face_count, r.cover_face_id, r.fresh) == (p.faces, p.cover, p.fresh)
        assert np.allclose(r.centroid, p.centroid, atol=1e-5)


def test_a_batch_ends_where_its_shortlists_do_not_suffice():
    v = online.unit([1.0, 0.2])
    a = online.Assigner([online.PersonState(i, online.unit([1.0, 0.1 * i]), 1.0) for i in range(5)], 9, image=1)
    fifth = a.nearest(v)[-1]
    assert a.decide(1, v, 0.9, absent=(fifth[0] + 1e-6, 7)) is None  # a nearer person may be absent
    assert a.decide(1, v, 0.9, absent=(fifth[0] - 1e-6, 7)) == 2
    few = online.Assigner([online.PersonState(0, v, 1.0)], 9, image=1)
    assert few.decide(1, v, 0.9, absent=(0.3, 7)) is None and few.decide(1, v, 0.9) == 0


def test_only_people_near_the_batch_reach_the_task(spark, monkeypatch):
    seen = []
    real = online._replay

    def spy(*args):
        run = real(*args)

        def wrapped(faces, people):
            out = run(faces, people)
            out.loc[out.face_id.notna(), "person_id"] = len(people)
            return out

        seen.append(1)
        return wrapped

    monkeypatch.setattr(online, "_replay", spy)
    eye = np.eye(64)
    people = spark.createDataFrame([(i, "", eye[i].tolist(), 1, -1) for i in range(64)], PEOPLE)
    faces = spark.createDataFrame([(i, i, eye[i].tolist(), 0.9, 0.9, "") for i in range(3)], FACES)
    assert {r.person_id for r in online.assign_online(faces, people).collect()} == {3} and seen == [1]


def test_odd_faces(spark):
    none = spark.createDataFrame([], PEOPLE)
    assert online.assign_online(spark.createDataFrame([], FACES), none).count() == 0
    e = [1.0, 0.0]
    rows = [(1, 1, e, None, None, None), (1, 2, None, 0.9, 0.9, None), (None, 3, e, 0.9, 0.9, None), (2, 4, [1.0], 0.9, 0.9, None), (3, 5, e, 0.9, 0.9, None), (4, 5, e, 0.9, 0.9, None), (5, None, e, 0.9, 0.9, None)]
    odd = spark.createDataFrame([(0, "", None, None, None), (1, "", [1.0, 0.0, 0.0], 2, None), (2, "", [], 1, 1)], PEOPLE)
    got = online.assign_online(spark.createDataFrame(rows, FACES), odd)
    assert got.columns == ["face_id", "person_id"]
    assert sorted(map(tuple, got.collect())) == [(1, -1), (2, -1), (3, -1), (4, -1), (5, 3), (5, 3)]


def test_batches_are_whole_where_no_near_person_is_absent(spark, monkeypatch):
    """Before, a batch ended where a face's own list did not suffice, although other faces had brought all people there are."""
    began, real = [], online.shortlists
    monkeypatch.setattr(online, "shortlists", lambda *a: began.append(1) or real(*a))
    vs, _ = vectors(300, 25, 24, 0.9, 3)
    faces = [(i, i, v, 0.8, 0.9, "x") for i, v in enumerate(vs)]
    got = online.assign_online(spark.createDataFrame(faces, FACES), spark.createDataFrame([], PEOPLE), batch=100, kept=5).collect()
    assert {r.face_id: r.person_id for r in got} == sequential(faces, [], 0)[0]
    assert len(began) == 3
