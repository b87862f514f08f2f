"""Interfaces of estimators, models and transformers, and small helpers around them."""

from __future__ import annotations

import copy
import importlib.util
import inspect
from collections.abc import Callable


class _Parameters:
    def get_params(self) -> dict:
        return {k: getattr(self, k) for k in inspect.signature(type(self)).parameters if hasattr(self, k)}

    def set_params(self, **params):
        for k, v in params.items():
            if k not in inspect.signature(type(self)).parameters:
                raise ValueError(f"unknown parameter {k}")
            setattr(self, k, v)
        return self


class Model(_Parameters):
    def copy(self):
        return copy.deepcopy(self)


class Estimator(_Parameters):
    """fit(data) keeps a model; data are DataFrames, so they never change."""

    def __init__(self, model: Model | None = None):
        self._model = model

    def fit(self, data, **kw):
        raise NotImplementedError

    def fetch_model(self):
        return self._model

    def fit_fetch(self, data, **kw):
        self.fit(data, **kw)
        return self.fetch_model()

    has_model = property(lambda self: self._model is not None)
    model = property(fetch_model)


class Transformer:
    def transform(self, data, **kw):
        raise NotImplementedError

    def __call__(self, *args, **kw):
        return self.transform(*args, **kw)


class EstimatorTransformer(Estimator, Transformer):
    def fit_transform(self, data, **kw):
        return self.fit_fetch(data, **kw).transform(data)


class ProgressCallback:
    """Counts steps on a progress bar with update() and close(), if one is given; keeps the last error where told."""

    def __init__(self, progress: Callable | None = None, desc: str | None = None, total: int | None = None):
        self.bar, self.steps, self.error = (progress(total=total) if progress else None), 0, None
        if self.bar is not None and desc and hasattr(self.bar, "set_description"):
            self.bar.set_description(desc)

    def __call__(self, n: int = 1, error: float | None = None) -> None:
        self.steps, self.error = self.steps + n, error
        if self.bar is not None:
            self.bar.update(n)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.bar is not None and hasattr(self.bar, "close"):
            self.bar.close()


def module_available(name: str) -> bool:
    return importlib.util.find_spec(name) is not None


def try_import(name: str):
    return importlib.import_module(name) if module_available(name) else None


def call_member(obj, name: str, *args, **kw):
    """An attribute, or a method's result."""
    found = getattr(obj, name)
    return found(*args, **kw) if callable(found) else found


class cached_property:
    """A property computed once; `del obj.name` makes it due again."""

    def __init__(self, f: Callable):
        self.f, self.name, self.__doc__ = f, f.__name__, f.__doc__

    def __get__(self, obj, kind=None):
        if obj is None:
            return self
        cache = obj.__dict__.setdefault("_cached", {})
        if self.name not in cache:
            cache[self.name] = self.f(obj)
        return cache[self.name]

    def __set__(self, obj, value):
        obj.__dict__.setdefault("_cached", {})[self.name] = value

    def __delete__(self, obj):
        obj.__dict__.get("_cached", {}).pop(self.name, None)
