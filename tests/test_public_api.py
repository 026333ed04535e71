"""The public surface: names and what they take."""

import inspect

import sluice

SIGNATURES = {
    "clip": ["graph", "layer"],
    "clip_file": ["spark", "source", "boundaries", "folder", "key", "fallback", "check_range", "progress", "split"],
    "load_dataset": ["spark", "path", "folder", "ontologies", "fallback"],
    "load_graph": ["spark", "paths", "fallback"],
    "merge_files": ["spark", "parts", "target", "progress"],
    "open_for_rewrite": ["spark", "source", "fallback"],
    "read_layer": ["spark", "path", "key"],
    "ready": ["spark"],
    "register": ["spark"],
    "rewrite": ["spark", "source", "target", "fallback", "renumber"],
    "rewrite_folder": ["spark", "source", "folder", "fallback"],
    "write_file": ["statements", "target", "prefixes", "renumber"],
    "write_folder": ["statements", "folder", "prefixes"],
    "write_parts": ["statements", "folder", "prefixes", "files", "split", "mode"],
}
CLASSES = {"Dataset", "Graph", "Hierarchy", "Store", "Terms"}


def test_names_and_parameters():
    assert set(sluice.__all__) == set(SIGNATURES) | CLASSES
    for name, parameters in SIGNATURES.items():
        assert list(inspect.signature(getattr(sluice, name)).parameters) == parameters, name
    assert all(inspect.isclass(getattr(sluice, name)) for name in CLASSES)


def test_dataset_questions_stay():
    asked = "nodes conduits of_class nodes_of conduits_of is_a graph_is_a types graph_types object_types falls_under closure version neighbours parts members attribute_values attribute_instances attributes_of_subjects labels climb conduit_nodes drawing_direction structural_differences repairs attribute_properties class_functions subset with_fillers register load"
    have = set(dir(sluice.Dataset)) | set(sluice.Dataset.__annotations__)
    assert set(asked.split()) <= have
