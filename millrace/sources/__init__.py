from .stages import copy_into, create_stage, drop_stage

__all__ = ["copy_into", "create_stage", "drop_stage"]
