from .workflow import Workflow, WorkflowResult

__all__ = ["Workflow", "WorkflowResult"]
