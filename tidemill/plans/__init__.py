"""Plans that join the operators: index build, retrieval, agent episodes."""
