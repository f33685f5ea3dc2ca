"""Code-fact analytics as DataFrame plans."""
