"""Reading objects, policies and reports; writing outputs and reports."""
