from fathom.llm import license_scan


def test_short_templates_are_found_next_to_any_word(make_docs):
    # Next to w617, w1871 and the like, a window of six words has no minimum in common with the template.
    numbers = [617, 1871, 4224, 7016, 7102, 9165, 10262, *range(200)]
    docs = [(n, f"Released under the MIT License w{n}") for n in numbers]
    found = license_scan.license_matches(make_docs(docs), {"MIT": "Released under the MIT License."}).collect()
    assert sorted(r.doc_id for r in found) == sorted(numbers)
