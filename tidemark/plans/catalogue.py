"""All registered queries; importing the modules fills the registry."""

from tidemark.plans import q_detect, q_eval, q_hulls, q_labels, q_pixels, q_scenes, q_sources, q_spectral, q_training, q_velocity  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
