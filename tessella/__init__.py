"""Record linkage at scale, expressed as DataFrame plans."""
